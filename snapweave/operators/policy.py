"""Layered policy and time-limited exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.functions.scalars import rank


def weakened(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """What a candidate policy gives up: rows (section, key, reason) of (section, key, value) tables.

    A disposition is weaker if its rank is lower; includes and inventory rows if they are gone or their
    binding differs. A removed disposition is weaker too.
    """
    b = base.select("section", "key", F.col("value").alias("old"))
    c = candidate.select("section", "key", F.col("value").alias("new"), F.lit(True).alias("kept"))
    reason = (
        F.when(F.col("kept").isNull(), "removed")
        .when((F.col("section") == "disposition") & (rank(F.col("new")) < rank(F.col("old"))), "weakened")
        .when((F.col("section") == "include") & ~F.col("new").eqNullSafe(F.col("old")), "rebound")
    )
    return b.join(c, ["section", "key"], "left").withColumn("reason", reason).filter("reason is not null").select("section", "key", "reason")


def include_union(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(path, kind, adapter) of either side; the candidate's binding wins."""
    c = candidate.select("path", "kind", F.col("adapter").alias("c"), F.lit(True).alias("in_c"))
    b = base.select("path", "kind", F.col("adapter").alias("b"))
    return c.join(b, ["path", "kind"], "full_outer").select("path", "kind", F.when(F.col("in_c"), F.col("c")).otherwise(F.col("b")).alias("adapter"))


def coverage(inventory: DataFrame, documents: DataFrame, entries: DataFrame) -> DataFrame:
    """State of each inventory path on the candidate: scanned, unsupported, outside or missing."""
    docs = documents.select("path", F.col("adapter").isNotNull().alias("read"))
    there = entries.select("path", F.lit(True).alias("there"))
    state = F.when(F.col("read"), "scanned").when(F.col("read").isNotNull(), "unsupported").when(F.col("there"), "outside").otherwise("missing")
    return inventory.select("path").distinct().join(docs, "path", "left").join(there, "path", "left").select("path", state.alias("state"))


def control_changes(protected: DataFrame, base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Protected paths that aren't present and equal on both sides: (path, base_state, candidate_state)."""
    state = lambda df, n: df.select("path", F.when(F.col("mode").isin("100644", "100755"), F.concat_ws(":", "mode", "oid")).otherwise("unsupported").alias(n))
    return (
        protected.select("path").distinct()
        .join(state(base, "base_state"), "path", "left")
        .join(state(candidate, "candidate_state"), "path", "left")
        .na.fill("absent", ["base_state", "candidate_state"])
        .filter("base_state <> candidate_state or base_state in ('absent', 'unsupported')")
    )


def debt(findings: DataFrame, items: DataFrame, now: int) -> DataFrame:
    """Debt items on findings of their key: applies, worsened, expired (both may hold), or unused."""
    on = findings.select("finding_key", F.col("fact").alias("now_fact"), F.lit(True).alias("found"))
    expired, worse = F.col("expires_at") <= now, F.col("found") & ~F.col("now_fact").eqNullSafe(F.col("accepted_fact"))
    outcome = F.array_compact(
        F.array(
            F.when(F.col("found").isNull(), "unused"),
            F.when(F.col("found") & expired, "debt-expired"),
            F.when(worse, "debt-worsened"),
            F.when(F.col("found") & ~expired & ~worse, "applies"),
        )
    )
    return items.join(on, "finding_key", "left").select("debt_id", "finding_key", F.explode(outcome).alias("outcome"))


def waiver_defects(items: DataFrame, findings: DataFrame, issuers: DataFrame, kinds: DataFrame, tree: str, now: int) -> DataFrame:
    """(waiver_id, defect) for each rule that a waiver breaks, in the order of the rules."""
    on = findings.select("finding_key", "kind", F.col("fact").alias("now_fact"))
    ok = issuers.select(F.col("issuer"), F.lit(True).alias("authorized")).distinct()
    allowed = kinds.select("kind", F.lit(True).alias("waivable")).distinct()
    rules = [
        ("finding-absent", F.col("kind").isNull()),
        ("fact-mismatch", F.col("kind").isNotNull() & ~F.col("now_fact").eqNullSafe(F.col("authorized_fact"))),
        ("tree-mismatch", F.col("candidate_tree") != tree),
        ("not-yet-valid", F.col("not_before") > now),
        ("expired", F.col("expires_at") <= now),
        ("issuer-unauthorized", F.col("authorized").isNull()),
        ("self-issued", F.col("owner") == F.col("issuer")),
        ("kind-not-waivable", F.col("kind").isNotNull() & F.col("waivable").isNull()),
    ]
    defects = F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))
    return (
        items.join(on, "finding_key", "left").join(F.broadcast(ok), "issuer", "left").join(F.broadcast(allowed), "kind", "left")
        .select("waiver_id", F.posexplode(defects).alias("position", "defect"))
    )


def with_exceptions(findings: DataFrame, debts: DataFrame, waivers: DataFrame) -> DataFrame:
    """findings with the exception that applies: debt or waiver; both overlap and neither applies."""
    d = debts.select("finding_key", F.lit(True).alias("debt")).distinct()
    w = waivers.select("finding_key", F.lit(True).alias("waiver")).distinct()
    both = F.col("debt").isNotNull() & F.col("waiver").isNotNull()
    exception = F.when(both, "overlap").when(F.col("debt"), "debt").when(F.col("waiver"), "waiver").otherwise("none")
    out = findings.join(d, "finding_key", "left").join(w, "finding_key", "left").withColumn("exception", exception)
    after = F.when((F.col("exception").isin("debt", "waiver")) & (F.col("effective") == "fail"), "warn").otherwise(F.col("effective"))
    return out.withColumn("final", after).drop("debt", "waiver")


def tightened(defaults: DataFrame, floor: DataFrame) -> DataFrame:
    """(resource, limit): the lower of the default and the floor's maximum."""
    f = floor.groupBy("resource").agg(F.min("maximum").alias("maximum"))
    return defaults.join(f, "resource", "left").select("resource", F.least("limit", F.coalesce("maximum", "limit")).alias("limit"))
