"""Vectorised text primitives shared by the operators.

A batch of texts is handled as one UTF-8 byte buffer: word and line boundaries, word hashes and
per-document sums are numpy operations over that buffer, so no Python loop runs over words.

Words are maximal runs of bytes other than space and the controls 9-13 (those bytes never occur
inside a multi-byte UTF-8 character). A null text is an empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes handled at once; a single longer text makes a chunk of its own.
CHUNK = 1 << 20

_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_P))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, CHUNK + 1)
        for k, base in enumerate((_P, _PINV)):
            steps = np.full(m, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def trim() -> None:
    """Freed memory goes back to the system: workers live on between tasks, and their pools keep it otherwise."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if free is not None:
        free(0)


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows, about `most` bytes each; nulls are empty."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for part in parts:
        if not len(part):
            continue
        if part.null_count:
            part = part.fill_null("")
        large = pa.types.is_large_string(part.type)
        buffers = part.buffers()
        offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)
        offsets = offsets[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
        a = 0
        while a < len(part):
            b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
            b = min(max(b, a + 1), len(part))
            yield row + a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b
        row += len(part)
    trim()


class Spans:
    """Half-open byte spans [start, end) in order, and the index of the first span of each row."""

    def __init__(self, start: np.ndarray, end: np.ndarray, offsets: np.ndarray):
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets)
        self.count = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> Spans:
    gap = _SPACE[data]
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    left = np.ones(n, bool)
    left[1:] = gap[:-1]
    left |= begins[:n]
    right = np.ones(n, bool)
    right[:-1] = gap[1:]
    right |= begins[1:]
    return Spans(np.flatnonzero(left & ~gap), np.flatnonzero(right & ~gap) + 1, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Lines between newlines; a text of no bytes has one empty line, as split() gives."""
    cuts = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
    row_of_cut = np.searchsorted(offsets, cuts, "right") - 1
    per_row = 1 + np.bincount(row_of_cut, minlength=len(offsets) - 1)
    spans = Spans.__new__(Spans)
    spans.start = start
    last = np.cumsum(per_row) - 1
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    end[last] = offsets[1:]
    spans.end, spans.count = end, per_row
    spans.first = np.concatenate([[0], np.cumsum(per_row)])
    return spans


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix values from which hash_spans takes the hash of any byte span."""
    power, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=out[1:])
    return out


def hash_spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes give equal hashes, wherever they stand."""
    _, inverse = _power(len(pre))
    return mix((pre[end] - pre[start]) * inverse[start] + (end - start).astype(U64))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive hashes; entry i covers i to i+k-1."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out = (out + h[j : j + n]) * U64(_P | 1) ^ (out >> U64(29))
    return mix(out)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]] for each row, empty rows too."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row; a row of 1 to k-1 words is one shingle."""
    data = lower(data)
    words = word_spans(data, offsets)
    h = hash_spans(prefix(data), words.start, words.end)
    runs = combine(h, k)
    out = []
    for a, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(runs[a : a + n - k + 1]))
        elif n:
            # as long as the row is: the number of words goes into the hash
            out.append(mix(combine(h[a : a + n], n) + U64(n)))
        else:
            out.append(np.zeros(0, U64))
    return out


def lists(values: list[np.ndarray]) -> pa.Array:
    """An Arrow list<int64> of arrays of 64-bit integers, signed or not."""
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64, copy=False)))
