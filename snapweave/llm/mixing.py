"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a cap of max_epochs times its size. The budget is shared by weight;
sources whose share is above their cap stop there, and the excess is shared again by weight among
the others. The end of that process is the level L with sum(min(cap, L * weight)) = budget, which a
running sum over the sources in order of cap / weight gives at once.

A source repeats all its documents floor(target / size) times. The fraction that is left takes
documents in a seeded order (md5 of seed and key) up to the one that crosses it, which is taken in
part. That document is found from sums over md5 buckets, so no source is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapweave.llm._tables import checkpoint, maybe_broadcast, unused

#: Words, as all operators count them.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Words of a text column as long; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size); one row per source.

    Weights repeat over the sources by code point, null last. share is the budget as a fraction of
    all sizes. A source of size 0 has target 0; if the budget is above all caps, each is at its cap.
    """
    ranked = sizes.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(w).cast("long") for w in weights]),
            (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1,
        ),
    ).withColumn("cap", F.col("source_size") * max_epochs)
    whole = Window.partitionBy(F.lit(0))
    before = (
        Window.partitionBy(F.lit(0))
        .orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    up, down = share
    filled = (
        ranked.withColumn("over", F.sum("source_size").over(whole) * up)
        .withColumn("over", F.col("over") - F.coalesce(F.sum("cap").over(before), F.lit(0)) * down)
        .withColumn("under", (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))) * down)
        # the first source in order that its share leaves below its cap sets the level
        .withColumn("open", F.col("over") * F.col("weight") <= F.col("cap") * F.col("under"))
        .withColumn(
            "level",
            F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("over"), F.col("under")))).over(whole),
        )
    )
    share_of = (F.col("weight") * F.col("level.over")).cast("double") / F.col("level.under")
    return filled.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(share_of, F.col("cap").cast("double"))).alias("target")
    )


def plan(
    docs: DataFrame,
    weights: tuple[int, ...],
    share: tuple[int, int],
    max_epochs: int,
    seed: str,
    key: str,
    text: str,
    source: str,
) -> tuple[DataFrame, DataFrame]:
    """(sized documents, one row per source with its target, repetitions and cut)."""
    sized = checkpoint(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).alias("source"),
            word_count(text).alias("size"),
            order(key, seed).alias("h"),
        )
    )
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    per = (
        per.withColumn("quota", F.floor(F.col("target") + 0.5))
        .withColumn("whole", F.coalesce(F.try_divide("quota", "source_size").cast("long"), F.lit(0)))
        .withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size"))
    )
    per = checkpoint(per)
    few = per.count()
    ours = F.col("source").eqNullSafe(F.col("_source"))
    small = maybe_broadcast(per.filter("rest > 0").select(F.col("source").alias("_source"), "rest"), few)
    buckets = sized.groupBy("source", F.substring("h", 1, 3).alias("bucket")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket")
    crossing = (
        buckets.withColumn("upto", F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .join(small, ours)
        .filter("upto >= rest and upto - words < rest")
        .select("_source", "bucket", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("left"))
    )
    inner = Window.partitionBy("_source").orderBy("h", "k").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        sized.withColumn("bucket", F.substring("h", 1, 3))
        .join(maybe_broadcast(crossing.withColumnRenamed("bucket", "_bucket"), few), ours & (F.col("bucket") == F.col("_bucket")))
        .groupBy("_source", "h", F.coalesce(F.col("key").cast("string"), F.lit("")).alias("k"))
        .agg(F.sum("size").alias("size"), F.max("left").alias("left"))
        .withColumn("upto", F.sum("size").over(inner))
        .filter("upto >= left and upto - size < left")
        .select("_source", F.col("h").alias("cut"), (F.col("left") - F.col("upto") + F.col("size")).alias("part"), F.col("size").alias("part_of"))
    )
    per = per.join(cut, ours, "left").drop("_source")
    return sized, checkpoint(per)


def order(key: str, seed: str) -> Column:
    """The seeded order of documents: hexadecimal md5 of the seed, a colon and the key as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    max_epochs: int = 2,
    seed: str = "mix",
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row (key, size, source_size, target, taken) per row of docs.

    size is the number of words (null text: 0), taken the words that the mix takes of the document,
    repeats counted. A source's taken words are its target, rounded, but for what is lost where rows
    repeat the key at the cut, which share the part by size, rounded down. A null source is a source;
    an empty table gives an empty table; other columns are not read. The same rows give the same mix
    in any partitioning.
    """
    sized, per = plan(docs, weights, share, max_epochs, seed, key, text, source)
    per = per.withColumnRenamed("source", "_source")
    extra = (
        F.when(F.col("h") < F.col("cut"), F.col("size"))
        .when(F.col("h") == F.col("cut"), F.expr("size * part div part_of"))
        .otherwise(F.lit(0))
    )
    return sized.join(maybe_broadcast(per), F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken")
    )


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    max_epochs: int = 2,
    seed: str = "mix",
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The rows of docs, each as often as the mix repeats it, with all their columns.

    Whole documents only: the one that crosses a source's fraction is taken if at least half of it is.
    Documents never move between partitions: only the cut of each source is joined to them.
    """
    _, per = plan(docs, weights, share, max_epochs, seed, key, text, source)
    mix_, copy = unused(docs, "mix"), unused(docs, "copy")
    few = maybe_broadcast(per.select(F.struct("source", "whole", "cut", F.expr("2 * part >= part_of").alias("half")).alias(mix_)))
    own, h = F.col(mix_), order(key, seed)
    once = F.coalesce((h < own["cut"]) | ((h == own["cut"]) & own["half"]), F.lit(False))
    times = (own["whole"] + once.cast("long")).cast("int")
    return (
        docs.join(few, F.col(source).eqNullSafe(own["source"]))
        .select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias(copy))
        .select(*docs.columns)
    )
