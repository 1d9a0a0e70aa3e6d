"""Statistics of whole texts, vectorised over a batch, for the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.llm import _text as T

#: Exact counts of a text, in the order in which describe() returns them.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower",
    "n_digits", "n_punct", "n_other", "n_distinct", "n_stops", "max_word", "top_word", "n_short", "n_bangs", "n_bars",
)


def _is(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL = _is("#*$%&|<>")
_UPPER = _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWERCASE = _is("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _is("0123456789")
_PUNCT = _is("!\"'()+,-./:;=?@[\\]^_`{}~")
_STOP = _is(".!?")


def _repeats(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times that each entry's hash occurs in its row, distinct hashes per row, greatest count per row)."""
    if not len(h):
        zero = np.zeros(rows, np.int64)
        return np.zeros(0, np.int64), zero, zero
    key = T.mix(h + T.mix(row.astype(T.U64)))
    order = np.argsort(key)
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.concatenate([first, [len(k)]]))
    times = np.empty(len(h), np.int64)
    times[order] = np.repeat(size, size)
    owner = row[order[first]]
    distinct = np.bincount(owner, minlength=rows)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, owner, size)
    return times, distinct, most


def describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each row, as an int64 matrix.

    A repeated word is in a run of three words that its text has twice or more; a repeated line has a
    word and equals an earlier line of its text. Empty texts have 0 everywhere.
    """
    rows = len(offsets) - 1
    words = T.word_spans(data, offsets)
    pre = T.prefix(data)
    h = T.hash_spans(pre, words.start, words.end)
    lines = T.line_spans(data, offsets)
    has = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    start, end, row = lines.start[has], lines.end[has], lines.row[has]
    _, kinds, _ = _repeats(row, T.hash_spans(pre, start, end), rows)
    written = np.bincount(row, minlength=rows)

    owner = words.row
    three = T.combine(h, 3)
    inside = owner[: len(three)] == owner[2:] if len(three) else np.zeros(0, bool)
    times, _, _ = _repeats(owner[: len(three)][inside], three[inside], rows)
    again = np.zeros(len(three), bool)
    again[np.flatnonzero(inside)[times > 1]] = True
    covered = np.zeros(len(h), bool)
    for j in range(3):
        covered[j : j + len(three)] |= again
    _, distinct, top = _repeats(owner, h, rows)

    per = lambda x: T.row_sums(x, offsets)
    points = (data & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(points)])
    length = total[words.end] - total[words.start]
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, owner, length)
    words_of = lambda x: np.bincount(owner, weights=x, minlength=rows).astype(np.int64)
    return np.stack(
        [
            words.count, words_of(length), per(_SYMBOL[data]), written - kinds, words_of(covered), written, per(_UPPER[data]),
            per(_LOWERCASE[data]), per(_DIGIT[data]), per(_PUNCT[data]), per(data >= 0xC0), distinct,
            words_of(_STOP[data[words.end - 1]] if len(h) else length), longest, top, words_of(length <= 3),
            per(data == ord("!")), per(data == ord("|")),
        ],
        axis=1,
    ).astype(np.int64)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        for row, data, offsets in T.chunks(texts):
            x = describe(data, offsets)
            rest = [batch.column(i).slice(row, len(x)) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), *rest], [*COUNTS, *batch.schema.names[1:]])


def counted(docs: DataFrame, text: str, **others: str) -> DataFrame:
    """COUNTS of each row of docs, and the columns `others` (new name = name)."""
    source = docs.select(F.col(text).cast("string").alias("_text"), *[F.col(c).alias(n) for n, c in others.items()])
    kinds = [f"{n} bigint" for n in COUNTS] + [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    return source.mapInArrow(_run, ", ".join(kinds))


def features(x: np.ndarray) -> np.ndarray:
    """Bounded ratios of COUNTS rows, for models."""
    c = {n: x[:, i].astype(np.float64) for i, n in enumerate(COUNTS)}
    words, chars, lines = c["n_words"] + 1, c["word_chars"] + 1, c["n_lines"] + 1
    letters = c["n_upper"] + c["n_lower"] + c["n_other"] + 1
    return np.stack(
        [
            np.log(words), np.log(chars / words), c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
            np.log(words / lines), c["n_upper"] / letters, c["n_digits"] / chars, c["n_punct"] / chars, c["n_other"] / chars,
            np.log((c["n_distinct"] + 1) / words), c["n_stops"] / words, np.log(c["max_word"] + 1), c["top_word"] / words,
            c["n_short"] / words, c["n_bangs"] / chars, c["n_bars"] / chars,
        ],
        axis=1,
    )


FEATURES = (
    "log words", "log word length", "symbols", "repeated lines", "repeated words", "log line length", "upper case", "digits",
    "punctuation", "beyond ascii", "log distinct", "sentence ends", "log longest word", "commonest word", "short words", "bangs", "bars",
)
