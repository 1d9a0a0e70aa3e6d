"""References against the entries of a snapshot: point, directory, ancestor and neighbour lookups.

Prefix conditions are turned into equi-joins by listing ancestors, so no join is a range join. Which
side is broadcast is left to the planner's sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapweave.functions import paths
from snapweave.functions.scalars import ascii_lower


def directories(entries: DataFrame, path: str = "path") -> DataFrame:
    """Every directory that an entry implies, the root '' included; distinct rows (path)."""
    return entries.select(F.explode(paths.ancestors(F.col(path))).alias("path")).distinct()


def locate(refs: DataFrame, entries: DataFrame, target: str = "target") -> DataFrame:
    """refs with mode and oid of the entry, or mode 'implied' for a directory that only holds entries."""
    found = refs.join(entries.select(F.col("path").alias(target), "mode", "oid"), target, "left")
    implied = directories(entries).select(F.col("path").alias(target), F.lit(True).alias("is_directory"))
    return (
        found.join(implied, target, "left")
        .withColumn("mode", F.coalesce("mode", F.when(F.col("is_directory"), "implied")))
        .drop("is_directory")
    )


def resolution(mode: Column, promised: Column | None = None) -> Column:
    """Kind of a repository reference by the mode of what it names (null: nothing)."""
    blob, tree = mode.isin("100644", "100755"), mode.isin("040000", "implied")
    out = F.when(mode.isNull(), "missing").when(mode.isin("120000", "160000"), "unsupported-target")
    if promised is not None:
        out = out.when((promised == "blob") & tree | (promised == "tree") & blob, "type-mismatch")
    return out.otherwise("resolved")


def first_candidate(refs: DataFrame, entries: DataFrame, key: str = "id", target: str = "target") -> DataFrame:
    """(key, served): the first router spelling of each reference that is a regular file."""
    tried = refs.select(key, F.posexplode(paths.router_candidates(F.col(target))).alias("pos", "path"))
    files = entries.filter(F.col("mode").isin("100644", "100755")).select("path")
    return tried.join(files, "path").groupBy(key).agg(F.min_by("path", "pos").alias("served"))


def nearest_rule(rows: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """rows with the rule of the deepest ancestor, or of the path itself; (rules: at, rule).

    As-of on depth: the path and its ancestors are listed, joined and the deepest match is kept.
    """
    listed = rows.select(
        F.col(path).alias("_path"), F.posexplode(F.concat(F.array(F.col(path)), paths.ancestors(F.col(path)))).alias("up", "at")
    ).distinct()
    best = listed.join(rules, "at").groupBy("_path").agg(F.min_by("rule", "up").alias("rule"))
    return rows.join(best, rows[path] == best["_path"], "left").drop("_path")


def case_neighbour(missing: DataFrame, entries: DataFrame, target: str = "target") -> DataFrame:
    """missing with `near`: the one entry that differs in the case of A-Z only, else null."""
    one = (
        entries.groupBy(ascii_lower(F.col("path")).alias("folded"))
        .agg(F.count("*").alias("n"), F.min("path").alias("near"))
        .filter("n = 1")
        .select("folded", "near")
    )
    return missing.withColumn("folded", ascii_lower(F.col(target))).join(one, "folded", "left").drop("folded")


def unique_or_null(keys: DataFrame, rows: DataFrame, on: list[str], value: str) -> DataFrame:
    """keys with the one value of rows that has their key, null for none or several, and how many."""
    one = rows.groupBy(*on).agg(F.count("*").alias("found"), F.min(value).alias(value))
    return keys.join(one, on, "left").withColumns(
        {"found": F.coalesce("found", F.lit(0)), value: F.when(F.col("found") == 1, F.col(value))}
    )


def anchor_lookup(refs: DataFrame, anchors: DataFrame) -> DataFrame:
    """refs (id, target, fragment) against anchors (target, anchor): exact, else the one typographic neighbour."""
    folded = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit("-"))
    known = anchors.select("target", F.col("anchor").alias("fragment")).distinct().withColumn("known", F.lit(True))
    near = (
        anchors.select("target", "anchor")
        .distinct()
        .groupBy("target", folded(F.col("anchor")).alias("folded"))
        .agg(F.count("*").alias("n"), F.min("anchor").alias("near"))
        .filter("n = 1")
        .drop("n")
    )
    return (
        refs.join(known, ["target", "fragment"], "left")
        .withColumn("folded", folded(F.col("fragment")))
        .join(near, ["target", "folded"], "left")
        .select(
            "id", "target", "fragment",
            F.when(F.col("known"), "resolved").otherwise("missing").alias("resolution"),
            F.when(F.col("known").isNull(), F.col("near")).alias("near"),
        )
    )


def first_definition(definitions: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return (
        definitions.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")
    )
