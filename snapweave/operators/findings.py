"""Findings: what is broken, on which side, and how much it matters under a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapweave.functions.scalars import disposition, rank

# Disposition of each finding kind under the observe and enforce profiles.
DISPOSITIONS = {
    "explicit-target-missing": ("warn", "fail"),
    "explicit-target-type-mismatch": ("warn", "fail"),
    "invalid-reference": ("warn", "fail"),
    "target-declared-untracked": ("record", "record"),
    "unsupported-reference-semantics": ("record", "record"),
    "unsupported-document-format": ("record", "record"),
    "unsupported-target-kind": ("record", "record"),
    "unsupported-version-scope": ("record", "record"),
    "unsupported-capability": ("fail", "fail"),
    "dependency-changed-subject-unchanged": ("warn", "warn"),
    "dependency-and-subject-cochanged": ("record", "record"),
    "subject-changed": ("record", "record"),
    "explicit-reference-removed": ("record", "record"),
    "document-removed": ("record", "record"),
    "opaque-mdx-region": ("record", "record"),
    "opaque-html-region": ("record", "record"),
    "observation-correlation-ambiguous": ("record", "record"),
    "unlinked-document": ("record", "record"),
    "policy-weakened": ("fail", "fail"),
    "coverage-reduced": ("fail", "fail"),
    "control-plane-changed": ("fail", "fail"),
    "debt-worsened": ("fail", "fail"),
    "debt-expired": ("fail", "fail"),
    "waiver-invalid": ("fail", "fail"),
    "claim-broken": ("warn", "fail"),
    "claim-target-missing": ("warn", "fail"),
}
#: Finding kind of a resolution that is grouped by its key, and of one that is reported one by one.
STRUCTURAL = {"missing": "explicit-target-missing", "type-mismatch": "explicit-target-type-mismatch"}
BOUNDARY = {
    "invalid": "invalid-reference",
    "unsupported-semantics": "unsupported-reference-semantics",
    "unsupported-target": "unsupported-target-kind",
    "unsupported-version": "unsupported-version-scope",
    "declared-untracked": "target-declared-untracked",
}


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def configured(kind: Column, profile: str) -> Column:
    """Built-in disposition of a finding kind; the introduced-only profile starts from enforce."""
    at = 0 if profile == "observe" else 1
    return lookup(kind, {k: v[at] for k, v in DISPOSITIONS.items()})


def attribution(in_base: Column, in_candidate: Column, equal: Column) -> Column:
    return F.when(~in_base, "introduced").when(~in_candidate, "resolved").when(equal, "pre-existing").otherwise("unknown")


def structural(base: DataFrame, candidate: DataFrame, key: list[str], member: str = "id") -> DataFrame:
    """Missing and mismatched references of both sides, grouped by finding key.

    A fact is the resolution and how often it occurs; the finding is pre-existing if both sides have an
    equal fact. One pass: both sides are aggregated together, before the shuffle as far as it goes.
    """
    side = lambda df, n: df.filter(F.col("resolution").isin(*STRUCTURAL)).select(*key, "resolution", member, F.lit(n).alias("_side"))
    of = lambda n: F.count_if(F.col("_side") == n)
    return (
        side(base, 0)
        .unionAll(side(candidate, 1))
        .withColumn("kind", lookup(F.col("resolution"), STRUCTURAL))
        .groupBy(*key, "kind")
        .agg(of(0).alias("base_count"), of(1).alias("candidate_count"), F.min(F.when(F.col("_side") == 1, F.col(member))).alias("representative"))
        .withColumn(
            "attribution",
            attribution(F.col("base_count") > 0, F.col("candidate_count") > 0, F.col("base_count") == F.col("candidate_count")),
        )
    )


def boundary(candidate: DataFrame) -> DataFrame:
    """One finding per candidate occurrence whose resolution is at the boundary of what is checked."""
    return candidate.filter(F.col("resolution").isin(*BOUNDARY)).withColumn("kind", lookup(F.col("resolution"), BOUNDARY))


def document_findings(documents: DataFrame) -> DataFrame:
    """(path, kind) from paired documents with b, c, adapter, references, mdx_bytes and html_bytes."""
    here = F.col("c").isNotNull()
    kinds = F.array(
        F.when(~here, "document-removed"),
        F.when(here & F.col("adapter").isNull(), "unsupported-document-format"),
        F.when(here & (F.col("mdx_bytes") > 0), "opaque-mdx-region"),
        F.when(here & (F.col("html_bytes") > 0), "opaque-html-region"),
        F.when(here & F.col("adapter").isNotNull() & (F.col("references") == 0), "unlinked-document"),
    )
    return documents.select("path", F.explode(F.array_compact(kinds)).alias("kind"))


def raised(findings: DataFrame, *layers: DataFrame) -> DataFrame:
    """findings (kind, disposition) after each layer (kind, least) that may only raise; the steps taken.

    Every step has the rank before and after it, in the order of the layers.
    """
    out = findings.withColumn("_rank", rank(F.col("disposition"))).withColumn("steps", F.array().cast("array<string>"))
    for i, layer in enumerate(layers):
        own = layer.groupBy("kind").agg(F.max(rank(F.col("least"))).alias("_least"))
        up = F.col("_least") > F.col("_rank")
        out = (
            out.join(own, "kind", "left")
            .withColumn(
                "steps",
                F.when(up, F.array_append("steps", F.concat(F.lit(f"{i}:"), disposition(F.col("_rank")), F.lit(">"), disposition(F.col("_least"))))).otherwise(F.col("steps")),
            )
            .withColumn("_rank", F.when(up, F.col("_least")).otherwise(F.col("_rank")))
            .drop("_least")
        )
    return out.withColumn("effective", disposition(F.col("_rank"))).drop("_rank")


def demoted(effective: Column, attributed: Column) -> Column:
    """Introduced-only: what was there before warns where it would fail."""
    return F.when((effective == "fail") & (attributed == "pre-existing"), "warn").otherwise(effective)


def verdict(findings: DataFrame, errors: DataFrame) -> DataFrame:
    """One row (verdict, exit_code): errors, then any fail, decide."""
    failed = findings.agg(F.coalesce(F.bool_or(F.col("effective") == "fail"), F.lit(False)).alias("failed"))
    wrong = errors.agg((F.count("*") > 0).alias("wrong"))
    return failed.join(F.broadcast(wrong), F.lit(True)).select(
        F.when(F.col("wrong"), "incomplete").when(F.col("failed"), "fail").otherwise("pass").alias("verdict"),
        F.when(F.col("wrong"), 2).when(F.col("failed"), 1).otherwise(0).alias("exit_code"),
    )


def capped_errors(errors: DataFrame, most: int) -> DataFrame:
    """Distinct errors (path, code) in order; beyond `most`, the lowest most - 1 and a sentinel.

    Only most + 1 rows are ever sorted together: each task keeps its own lowest.
    """
    low = errors.select("path", "code").distinct().orderBy(F.col("path").asc_nulls_first(), "code").limit(most + 1)
    n = low.agg(F.count("*").alias("n"))
    kept = low.orderBy(F.col("path").asc_nulls_first(), "code").limit(most - 1)
    last = low.orderBy(F.col("path").asc_nulls_first(), "code").limit(most)
    over = kept.unionAll(errors.sparkSession.range(1).select(F.lit(None).cast("string").alias("path"), F.lit("too-many-errors").alias("code")))
    return (
        last.join(F.broadcast(n.filter(f"n <= {most}")), F.lit(True)).select("path", "code")
        .unionAll(over.join(F.broadcast(n.filter(f"n > {most}")), F.lit(True)).select("path", "code"))
    )


def claims(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Unattested claims (by, state, order) grouped: kind, members and the first of each group."""
    kind = F.when(F.col("state") == "broken", "claim-broken").otherwise("claim-target-missing")
    return (
        rows.filter("state <> 'attested'")
        .groupBy(*by, kind.alias("kind"))
        .agg(F.count("*").alias("members"), F.min(order).alias("first_id"))
    )


def multiplicities(rows: DataFrame, by: list[str], digest: str) -> DataFrame:
    """(by, members, digests): how many definitions each group has, and each digest with its count, sorted."""
    counts = rows.groupBy(*by, digest).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(
        F.sum("n").alias("members"), F.array_sort(F.collect_list(F.struct(digest, "n"))).alias("digests")
    )
