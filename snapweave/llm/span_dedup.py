"""Substring dedup by sliding sentence spans.

A sentence ends with a word that ends in '.', '!', '?', ',', ';' or ':', at a newline, or after
`longest` words: clauses count as sentences, so that a passage that is repeated from the middle of a
sentence on soon meets an end. From every sentence on the shortest run of sentences with `least` words
is hashed (words without the white space between them, A-Z lower-cased), the hashes are joined
globally, and a sentence is removed if it lies in any run that occurred before. First occurrences
stay. As `least` is above `longest` a run has several sentences, and a repeat of
least + 2 * (longest - 1) words with its own sentence ends holds a whole run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.llm import _text as T
from snapweave.llm._runs import later_runs
from snapweave.llm._tables import checkpoint

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?,;:"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[T.Spans, np.ndarray]:
    """(words, index of the last word of each sentence)."""
    words = T.word_spans(data, offsets)
    n = len(words.end)
    if not n:
        return words, np.zeros(0, np.int64)
    ends = _STOP[data[words.end - 1]]
    lines = np.searchsorted(np.flatnonzero(data == 10), words.start)
    ends[:-1] |= lines[1:] != lines[:-1]
    ends[words.first[1:][words.count > 0] - 1] = True
    # within a sentence every longest-th word ends one too
    first = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    at = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    ends |= at % longest == longest - 1
    return words, np.flatnonzero(ends)


def _spans(longest: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in T.chunks(batch.column(1)):
                data = T.lower(data)
                words, last = sentences(data, offsets, longest)
                h = T.hash_spans(T.prefix(data), words.start, words.end)
                first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
                bounds = np.searchsorted(last, words.first)
                # the sentence in which the least-th word from each sentence on stands, if its row has so many
                to = np.searchsorted(last, first + least - 1)
                whole = np.flatnonzero(first + least <= np.repeat(words.first[1:], np.diff(bounds)))
                begin, end = first[whole], last[to[whole]]
                # a run's hash from its words' hashes, by the same rolling sums
                power, inverse = T._power(len(h) + 1)
                total = np.zeros(len(h) + 1, T.U64)
                np.cumsum(h * power[: len(h)], out=total[1:])
                runs = T.mix((total[end + 1] - total[begin]) * inverse[begin] + (end - begin).astype(T.U64))
                cuts = pa.array(np.searchsorted(whole, bounds), pa.int32())
                base = np.repeat(bounds[:-1], np.diff(bounds))[whole]
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (whole - base, to[whole] - base, runs.view(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(bounds) - 1), pa.array(np.diff(bounds), pa.int64()), *lists], ["key", "n", "at", "to", "run"]
                )

    return run


def repeated_spans(
    docs: DataFrame, longest: int = 12, least: int = 30, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row (key, n, spans) per row of docs with removed sentences.

    n is the number of sentences; spans lists the removed runs (first, last), from 0. Of equal runs the
    first in the order of key (nulls first) and position stays; rows of one key follow each other, so of
    repeated rows one stays whole. Texts of fewer than `least` words, empty and null ones lose nothing.
    Other columns are not read.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    rows = source.mapInArrow(_spans(longest, least), f"key {kind}, n bigint, at array<bigint>, to array<bigint>, run array<bigint>")
    rows = checkpoint(rows.filter("size(run) > 0").withColumn("id", F.monotonically_increasing_id()))
    runs = rows.select("id", F.explode(F.arrays_zip("at", "to", "run")).alias("r")).select("id", "r.*")
    return later_runs(rows, runs, key)
