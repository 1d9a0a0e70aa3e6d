"""External destinations: what a change introduces, and what evidence says about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(destination, change, documents): introduced, removed or retained; the candidate's documents, sorted.

    A destination that moves between documents is retained.
    """
    side = lambda df, n: df.select("destination", "document", F.lit(n).alias("side"))
    in_b, in_c = F.max(F.when(F.col("side") == 0, 1)), F.max(F.when(F.col("side") == 1, 1))
    return (
        side(base, 0).unionAll(side(candidate, 1))
        .groupBy("destination")
        .agg(
            F.when(in_b.isNull(), "introduced").when(in_c.isNull(), "removed").otherwise("retained").alias("change"),
            F.array_sort(F.collect_set("document")).alias("documents"),
        )
    )


def binding_defects(plan: DataFrame, evidence: DataFrame) -> DataFrame:
    """(destination, defect): evidence for nothing in the plan, or more than once for one destination."""
    stray = evidence.join(plan.select("destination"), "destination", "left_anti").select("destination", F.lit("stray").alias("defect"))
    twice = evidence.groupBy("destination").count().filter("count > 1").select("destination", F.lit("duplicate").alias("defect"))
    return stray.distinct().unionAll(twice)


def verdict(method: Column, status: Column, failure: Column) -> Column:
    """What one probe proves: reachable, refuted, or unproven and why; null method is no evidence."""
    ok = status.between(200, 399)
    gone = status.isin(404, 410)
    return (
        F.when(method.isNull(), "unexamined")
        .when(failure.isNotNull(), "unproven/failed")
        .when(ok, "reachable")
        .when(gone & (method == "GET"), "refuted")
        .when(gone, "unproven/unconfirmed")
        .when(status.isin(401, 403, 999), "unproven/denied")
        .when(status == 429, "unproven/rate-limited")
        .otherwise("unproven/status")
    )


def assessed(plan: DataFrame, evidence: DataFrame) -> DataFrame:
    """plan with the verdict of its evidence; each destination has at most one row of evidence."""
    return plan.join(evidence, "destination", "left").withColumn("verdict", verdict(F.col("method"), F.col("status"), F.col("failure")))


def probe_targets(plan: DataFrame, most: int) -> DataFrame:
    """The first `most` https destinations without a repository shape: (destination, skipped)."""
    fit = plan.filter("scheme = 'https' and repository is null").select("destination").distinct()
    skipped = fit.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("skipped"))
    return fit.orderBy("destination").limit(most).join(F.broadcast(skipped), F.lit(True))


def until_stop(rows: DataFrame, by: list[str], order: str, stop: Column) -> DataFrame:
    """Rows of each group up to and including the first where stop holds."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_stops", F.coalesce(F.sum(stop.cast("int")).over(before), F.lit(0))).filter("_stops = 0").drop("_stops")
