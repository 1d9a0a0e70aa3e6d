"""Feedback, counters and the projections that leave the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapweave.functions.scalars import disposition, rank


def action(attribution: Column, on_candidate: Column) -> Column:
    """fix what is new, check what is unclear, list what was there; what is resolved needs nothing."""
    return (
        F.when(attribution == "resolved", F.lit(None).cast("string"))
        .when(attribution == "pre-existing", "existing")
        .when((attribution == "introduced") & on_candidate, "fix")
        .otherwise("check")
    )


def items(findings: DataFrame) -> DataFrame:
    """Feedback by (action, subject) of findings (kind, attribution, effective, subject, members, note)."""
    acted = (
        findings.filter("effective <> 'record'")
        .withColumn("action", action(F.col("attribution"), F.lit(True)))
        .filter("action is not null")
    )
    return acted.groupBy("action", "subject").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.sum("members").alias("members"),
        disposition(F.max(rank(F.col("effective")))).alias("disposition"),
        F.min(F.when(F.col("action") == "fix", F.col("note"))).alias("note"),
    )


def order_of(name: Column) -> Column:
    return F.when(name == "fix", 0).when(name == "check", 1).otherwise(2)


def windows(feedback: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` items of what is new and of what was there, with what each window leaves out.

    A limit per window keeps the sort small: partitions drop their own rest before they meet.
    """
    group = F.when(F.col("action") == "existing", "existing").otherwise("new")
    keyed = feedback.withColumn("window", group)
    place = F.row_number().over(Window.partitionBy("window").orderBy(order_of(F.col("action")), F.col("subject").asc_nulls_last(), "kinds"))
    left = keyed.groupBy("window").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("overflow"))
    return keyed.withColumn("place", place).filter(F.col("place") <= most).join(F.broadcast(left), "window").select(
        "window", "place", "action", "subject", "kinds", "members", "overflow"
    )


def percent_encoded(path: Column) -> Column:
    """Every byte but unreserved characters and '/' as %XX: url_encode, with its form rules undone."""
    out = F.url_encode(path)
    for was, now in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def sarif(findings: DataFrame) -> DataFrame:
    """SARIF results: rule, its index among the distinct kinds, level and location."""
    rules = findings.select("kind").distinct().withColumn("rule_index", F.row_number().over(Window.orderBy("kind")) - 1)
    level = F.when(F.col("effective") == "fail", "error").when(F.col("effective") == "warn", "warning").otherwise("note")
    return findings.join(F.broadcast(rules), "kind").select(
        "finding_key", F.col("kind").alias("rule_id"), "rule_index", level.alias("level"), percent_encoded(F.col("subject")).alias("uri"),
        F.greatest("line", F.lit(1)).alias("start_line"),
    )


def code_quality(findings: DataFrame) -> DataFrame:
    severity = F.when(F.col("effective") == "fail", "major").when(F.col("effective") == "warn", "minor").otherwise("info")
    return findings.select(
        F.col("finding_key").alias("fingerprint"), F.col("kind").alias("check_name"), severity.alias("severity"),
        F.coalesce("subject", F.lit("(global)")).alias("path"), F.greatest("line", F.lit(1)).alias("line"),
    )


def minted(findings: DataFrame, eligible: list[str]) -> tuple[DataFrame, DataFrame]:
    """(debt items, counts): failing findings of an eligible kind that have a fact; what was left out."""
    failing = findings.filter("effective = 'fail'")
    fits, fact = F.col("kind").isin(*eligible), F.col("fact").isNotNull()
    counts = failing.agg(
        F.count_if(fits & fact).alias("minted"), F.count_if(~fits).alias("ineligible"), F.count_if(fits & ~fact).alias("factless")
    )
    return failing.filter(fits & fact).select("finding_key", "kind", F.col("fact").alias("accepted_fact")), counts


def finding_counters(findings: DataFrame) -> DataFrame:
    """Totals by disposition, by attribution and overall, in one pass over grouping sets."""
    return (
        findings.groupingSets([("effective",), ("attribution",), ()], "effective", "attribution")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("_set"))
        .select(
            F.when(F.col("_set") == 1, "disposition").when(F.col("_set") == 2, "attribution").otherwise("all").alias("axis"),
            F.coalesce(F.when(F.col("_set") == 1, F.col("effective")).when(F.col("_set") == 2, F.col("attribution")), F.lit("")).alias("value"),
            "n",
        )
    )


def document_counters(documents: DataFrame) -> DataFrame:
    """One row of conditional counts over paired documents."""
    b, c = F.col("b").isNotNull(), F.col("c").isNotNull()
    return documents.agg(
        F.count("*").alias("documents"),
        F.count_if(b).alias("base"),
        F.count_if(c).alias("candidate"),
        *[F.count_if(F.col("change") == x).alias(x) for x in ("added", "removed", "changed", "unchanged")],
        F.count_if(c & F.col("adapter").isNotNull() & ~F.col("excluded")).alias("scanned"),
        F.count_if(c & F.col("excluded")).alias("excluded"),
        F.count_if(c & F.col("adapter").isNull() & ~F.col("excluded")).alias("unsupported"),
        F.coalesce(F.sum("b.bytes"), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("c.bytes"), F.lit(0)).alias("candidate_bytes"),
    )


def reference_counters(observations: DataFrame) -> DataFrame:
    """Counts by intent and resolution."""
    kinds = ("resolved", "missing", "type-mismatch", "unsupported-target", "unsupported-semantics", "external")
    return observations.groupBy("intent").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("resolution") == k).alias(k.replace("-", "_")) for k in kinds]
    )
