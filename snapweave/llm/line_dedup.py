"""Line dedup: winnowing over line hashes.

A document is the sequence of its lines that have a word, each hashed without the white space around
it. Of every `window` consecutive lines the least hash (the rightmost of equals) is a fingerprint, so
any run of `window` lines that two places share has a common fingerprint at the same place in both.
A line of `long` words or more is a fingerprint too, and a run of its own, and the lines of a text
with fewer than `window` are one run.
Positions are joined on the fingerprint; those that occur once in the corpus end here, most of the
lines. Around each other position the match is extended both ways: the window-long runs that hold
the position are hashed and looked up, and consecutive matches join into maximal runs. A run that
occurred before, in the order of (key, position), is deleted; its first occurrence stays.

Counts are aggregated before they shuffle, and the marks of hot lines stay in their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.llm import _text as T
from snapweave.llm._runs import later_runs
from snapweave.llm._tables import checkpoint, join_counted


def strip(data: np.ndarray, spans: T.Spans, words: T.Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, has a word) of spans without the white space at their ends."""
    a = np.searchsorted(words.start, spans.start)
    b = np.searchsorted(words.start, spans.end)
    has = b > a
    start, end = spans.start.copy(), spans.start.copy()
    start[has] = words.start[a[has]]
    end[has] = words.end[b[has] - 1]
    return start, end, has


def fingerprints(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each window, the rightmost of equals; of a shorter text, its first line."""
    if len(h) < window:
        return np.zeros(min(len(h), 1), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(1))


def _lines(window: int, long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in T.chunks(batch.column(1)):
                spans = T.line_spans(data, offsets)
                words = T.word_spans(data, offsets)
                start, end, has = strip(data, spans, words)
                many = np.searchsorted(words.start, spans.end) - np.searchsorted(words.start, spans.start) >= long
                h = T.hash_spans(T.prefix(data), start, end).view(np.int64)
                lines, marks, alone = [], [], []
                for a, b in zip(spans.first[:-1].tolist(), spans.first[1:].tolist(), strict=True):
                    own = h[a:b][has[a:b]]
                    lines.append(own)
                    alone.append(np.flatnonzero(many[a:b][has[a:b]]))
                    marks.append(np.union1d(fingerprints(own.view(T.U64), window), alone[-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(lines)),
                        pa.array([len(x) for x in lines], pa.int64()),
                        T.lists(lines),
                        T.lists(marks),
                        T.lists(alone),
                    ],
                    ["key", "n", "lines", "marks", "alone"],
                )

    return run


def repeated_lines(docs: DataFrame, window: int = 3, long: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, n, spans) per row of docs with deleted lines.

    n counts lines with a word; spans lists the deleted runs (first, last), counted over those lines
    from 0. A line is deleted if it lies in a run that equals an earlier run, in the order of key
    (nulls first) and position; `window` lines are a run, a line of `long` words is, and so are all lines
    of a text that has fewer than `window`. Rows of one key follow each other, so of repeated rows one
    stays. Null and empty texts have no lines. Other columns are not read.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    rows = source.mapInArrow(_lines(window, long), f"key {kind}, n bigint, lines array<bigint>, marks array<bigint>, alone array<bigint>")
    rows = checkpoint(rows.filter("size(marks) > 0").withColumn("id", F.monotonically_increasing_id()))
    marks = rows.select("id", "lines", F.explode("marks").alias("pos")).select(
        "id", "pos", F.get("lines", F.col("pos").cast("int")).alias("h")
    )
    shared = checkpoint(marks.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1"))
    found = join_counted(marks, shared, "h").groupBy("id").agg(F.collect_list("pos").alias("found"))
    # the starts of the runs that hold a found position; a short text is one run
    around = F.flatten(
        F.transform("found", lambda p: F.sequence(F.greatest(p - (window - 1), F.lit(0)), F.greatest(F.least(p, F.col("n") - window), F.lit(0))))
    )
    held = F.least(F.lit(window), F.col("n")).cast("int")
    runs = F.concat(
        F.transform(F.array_distinct(around), lambda at: F.struct(at.alias("at"), (at + held - 1).alias("to"))),
        F.when(F.col("n") > 1, F.transform(F.array_intersect("alone", "found"), lambda at: F.struct(at.alias("at"), at.alias("to")))).otherwise(F.array()),
    )
    runs = checkpoint(
        rows.join(found, "id")
        .select("id", "lines", F.explode(runs).alias("r"))
        .select("id", "r.at", "r.to", F.xxhash64(F.slice("lines", F.col("r.at").cast("int") + 1, (F.col("r.to") - F.col("r.at") + 1).cast("int"))).alias("run"))
    )
    return later_runs(rows, runs, key)
