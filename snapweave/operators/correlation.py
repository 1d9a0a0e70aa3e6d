"""Two sides of observations: equal ids, then groups of candidates, then what changed.

An observation has id, document, construct, intent, block, resolution and projection. Correlating
candidates looks like connected components but has a closed form: edges are complete within a group of
(construct, intent, document as renamed, block if renamed), so one aggregation per group decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def renames(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(removed, added) paths whose (mode, oid) is the only one of its kind among removed and added."""
    key = ["mode", "oid"]
    gone = base.join(candidate.select("path"), "path", "left_anti")
    new = candidate.join(base.select("path"), "path", "left_anti")
    one = lambda df, name: df.groupBy(*key).agg(F.count("*").alias("n"), F.min("path").alias(name)).filter("n = 1").drop("n")
    return one(gone, "removed").join(one(new, "added"), key).select("removed", "added")


def pair_documents(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Documents of both sides by path, and their change."""
    b = base.select("path", F.struct("mode", "oid", "bytes").alias("b"))
    c = candidate.select("path", F.struct("mode", "oid", "bytes").alias("c"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "removed").when(F.col("b").eqNullSafe(F.col("c")), "unchanged").otherwise("changed")
    return b.join(c, "path", "full_outer").withColumn("change", change)


def exact_pairs(base: DataFrame, candidate: DataFrame, names: list[str]) -> DataFrame:
    """Observations with one id on both sides; `names` of each side as b_ and c_ columns."""
    side = lambda df, p: df.select("id", *[F.col(n).alias(f"{p}_{n}") for n in names])
    return side(base, "b").join(side(candidate, "c"), "id")


def components(base: DataFrame, candidate: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """Groups of unmatched observations: (construct, intent, document, n_base, n_candidate, outcome).

    removed and new groups count one outcome per member: with members on one side only no edge joins
    them. Null keys compare equal, as in any grouping.
    """
    left = base.join(candidate.select("id"), "id", "left_anti")
    right = candidate.join(base.select("id"), "id", "left_anti")
    if renamed is not None:
        left = left.join(renamed.select(F.col("removed").alias("document"), "added"), "document", "left")
        right = right.join(renamed.select(F.col("added").alias("document"), F.lit(True).alias("moved")), "document", "left")
    else:
        left, right = left.withColumn("added", F.lit(None).cast(left.schema["document"].dataType)), right.withColumn("moved", F.lit(False))
    moved_block = lambda moved: F.when(moved, F.col("block"))
    both = left.select(
        "construct", "intent", F.coalesce("added", "document").alias("document"), moved_block(F.col("added").isNotNull()).alias("moved_block"),
        F.lit(1).alias("b"), F.lit(0).alias("c"),
    ).unionAll(
        right.select("construct", "intent", "document", moved_block(F.col("moved")).alias("moved_block"), F.lit(0).alias("b"), F.lit(1).alias("c"))
    )
    b, c = F.col("n_base"), F.col("n_candidate")
    outcome = F.when(c == 0, "removed").when(b == 0, "new").when((b == 1) & (c == 1), "candidate").otherwise("ambiguous")
    return (
        both.groupBy("construct", "intent", "document", "moved_block")
        .agg(F.sum("b").alias("n_base"), F.sum("c").alias("n_candidate"))
        .withColumn("outcome", outcome)
    )


def target_change(b_res: Column, c_res: Column, b_proj: Column, c_proj: Column) -> Column:
    """equal, changed, newly-resolved, became-missing or not-comparable."""
    gone = lambda c: c.isin("missing", "type-mismatch")
    same = b_proj.eqNullSafe(c_proj)
    return (
        F.when((b_res == "resolved") & (c_res == "resolved"), F.when(b_proj.isNull() | c_proj.isNull(), "not-comparable").when(same, "equal").otherwise("changed"))
        .when((b_res == c_res) & b_res.isin("missing", "type-mismatch", "declared-untracked") & same, "equal")
        .when(gone(b_res) & (c_res == "resolved"), "newly-resolved")
        .when((b_res == "resolved") & gone(c_res), "became-missing")
        .otherwise("not-comparable")
    )


def impact(change: Column, source_changed: Column) -> Column:
    """The quadrant of target change and source change."""
    return (
        F.when((change == "equal") & source_changed, "subject-changed")
        .when(change == "equal", "none")
        .when((change == "changed") & source_changed, "dependency-and-subject-cochanged")
        .when(change == "changed", "dependency-changed-subject-unchanged")
        .when(change == "newly-resolved", "reference-resolved")
        .otherwise("not-applicable")
    )
