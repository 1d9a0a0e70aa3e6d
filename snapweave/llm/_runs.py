"""First and later occurrences of hashed runs, for the operators that delete repeated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapweave.llm._tables import checkpoint, join_counted


def later_runs(rows: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Maximal spans of items in runs that occurred before.

    rows has (key, id, n): a row's key, its own id and its number of items. runs has (id, at, to, run):
    the first and the last item of a run, and its hash. Of equal runs the first in the order
    (key, id, at) stays. The result has a row (key, n, spans) for each id with later runs; spans are
    (first, last) items, touching ones as one. Hashes alone are counted first, before they shuffle;
    keys and places are sent only of runs that occur more than once, and the runs of a hot hash stay
    where they are.
    """
    times = checkpoint(runs.groupBy("run").agg(F.count("*").alias("times")).filter("times > 1"))
    found = checkpoint(join_counted(runs, times, "run").drop("times").join(rows.select("id", "key", "n"), "id"))
    place = F.struct("key", "id", "at", "to")
    first = checkpoint(found.groupBy("run").agg(F.min(place).alias("first"), F.count("*").alias("times")))
    later = join_counted(found, first, "run").filter("id <> first.id or at <> first.at")
    order = Window.partitionBy("id").orderBy("at", "to")
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        later.withColumn("new", (F.col("at") > F.coalesce(before, F.lit(-2)) + 1).cast("int"))
        .withColumn("group", F.sum("new").over(order))
        .groupBy("id", "key", "n", "group")
        .agg(F.struct(F.min("at").alias("first"), F.max("to").alias("last")).alias("span"))
        .groupBy("id", "key", "n")
        .agg(F.array_sort(F.collect_list("span")).alias("spans"))
        .select(F.col("key").alias(key), "n", "spans")
    )
