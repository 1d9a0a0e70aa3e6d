"""Lines, spans and HTML of documents, as generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapweave.functions.scalars import decode_entities, normalize_newlines, strip_markup


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, number, line): lines from 1, without an empty last one after the final newline."""
    whole = normalize_newlines(F.coalesce(F.col(text), F.lit("")))
    parts = F.split(whole, "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.select(key, F.posexplode(kept).alias("number", "line")).select(key, (F.col("number") + 1).alias("number"), "line")


def hrefs(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, position, destination) of every <a href> and <img src>, comments and raw text skipped."""
    clean = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<!--.*?-->|<(script|style|textarea|title)\b[^>]*>.*?</\1\s*>", "")
    found = F.regexp_extract_all(clean, F.lit(r"(?is)<(?:a\b[^>]*?\shref|img\b[^>]*?\ssrc)\s*=\s*\"([^\"]*)\""), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("position", "raw")).select(key, "position", decode_entities(F.col("raw")).alias("destination"))


def headings(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, position, level, heading) of closed h1 to h6 elements, markup stripped."""
    clean = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(clean, F.lit(r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>)"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("position", "raw")).select(
        key, "position", F.regexp_extract("raw", r"^<[hH]([1-6])", 1).cast("int").alias("level"), F.trim(decode_entities(strip_markup(F.col("raw")))).alias("heading")
    )


def anchors(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, anchor) of every id and name attribute; distinct."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<[a-z][^>]*?\s(?:id|name)\s*=\s*\"([^\"]+)\""), F.lit(1))
    return pages.select(key, F.explode(found).alias("anchor")).distinct()


def nonblank_runs(rows: DataFrame, key: str) -> DataFrame:
    """(key, runs): maximal runs of lines with something but blanks, of lines (key, number, line)."""
    blank = F.col("line").rlike(r"^[ \t]*$")
    starts = ~blank & F.coalesce(F.lag(blank).over(Window.partitionBy(key).orderBy("number")), F.lit(True))
    return rows.withColumn("_s", starts).groupBy(key).agg(F.count_if("_s").alias("runs"))


def merged_spans(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end): overlapping and touching half-open spans as one, by a fold per key.

    Nulls come last: a span without a start joins the one before it. Of spans with the same start and end
    the one that opens a group comes first, so its copies never join the group before.
    """
    per, order = Window.partitionBy(key), [F.asc_nulls_last("start"), F.asc_nulls_last("end")]
    reach = F.max("end").over(per.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("_new").over(per.orderBy(*order, F.desc("_new")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        spans.withColumn("_new", F.coalesce(reach.isNull() | (F.col("start") > reach), F.lit(False)).cast("int"))
        .withColumn("_island", island)
        .groupBy(key, "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_island")
    )


def overlapping(spans: DataFrame, key: str) -> DataFrame:
    """Keys with a span that begins before the one before it ends."""
    order = Window.partitionBy(key).orderBy("start", "end")
    return spans.withColumn("_last", F.lag("end").over(order)).filter("_last > start").select(key).distinct()


def spliced(docs: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """docs (key, text) with fixes (key, start, end, replacement) applied, characters, right to left.

    Documents whose fixes overlap or leave the text are returned as they are, with applied false.
    """
    per = fixes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("f"))
    n = F.length("text")
    inside = F.forall("f", lambda x: (x["start"] >= 0) & (x["start"] <= x["end"]) & (x["end"] <= n))
    apart = F.forall(F.sequence(F.lit(1), F.size("f")), lambda i: (i == 1) | (F.get("f", i - 2)["end"] <= F.get("f", i - 1)["start"]))
    new = F.aggregate(
        F.reverse("f"), F.col("text"),
        lambda t, x: F.concat(t.substr(F.lit(1), x["start"]), x["replacement"], t.substr(x["end"] + 1, F.length(t))),
    )
    good = inside & apart
    judged = docs.join(per, key).withColumn("applied", good)
    return judged.select(key, F.when(F.col("applied"), new).otherwise(F.col("text")).alias("text"), "applied")
