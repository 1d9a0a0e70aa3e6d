"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of bytes other than white space and ASCII punctuation, A-Z lower-cased, so case and
punctuation don't matter. An item or window is the multiset of its word shingles, each weighing as
often as it occurs. Each item has a 64-bit SimHash. In every document, the windows with as many words
as an item are fingerprinted; a multi-index over blocks of the fingerprint gives every item of that
size within the Hamming radius (radius // blocks flips within at least one block), and the weighted
similarity of window and item, sum of least over sum of greatest weights, decides.

A window without any shingle of an item has similarity 0 to it, so only the windows around a shingle
that an item of their size has are fingerprinted: none in most documents.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegralType, StringType

from snapweave.llm import _text as T

#: Items that are sent to the executors at once; a larger benchmark is taken in blocks of so many.
ITEMS = 20_000
#: Bits of the map that tells most shingles of documents from those of items.
_BITS = 1 << 22

_NORMAL = T.lower(np.arange(256, dtype=np.uint8))
_NORMAL[[b for b in range(33, 128) if not chr(b).isalnum()]] = 32


def normal(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, ASCII punctuation as spaces."""
    return _NORMAL[data]


def _signs(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _pack(total: np.ndarray) -> np.ndarray:
    return np.packbits(total > 0, axis=1).view(T.U64).reshape(-1)


class Index:
    """Items by size: shingles, fingerprints and block tables."""

    def __init__(self, items: list[tuple[object, str]], words: int, radius: int, blocks: int):
        self.k, self.radius, self.blocks = words, radius, blocks
        self.ids = [i for i, _ in items]
        texts = pa.array([t or "" for _, t in items], pa.string())
        self.bags: list[Counter] = []
        self.size: list[int] = []
        prints = []
        for _, data, offsets in T.chunks(texts):
            for h in word_hashes(data, offsets):
                grams = T.combine(h, min(words, len(h))) if len(h) else h
                self.bags.append(Counter(grams.tolist()))
                self.size.append(len(h))
                prints.append(_pack(_signs(grams).sum(0, keepdims=True))[0] if len(h) else T.U64(0))
        self.prints = np.array(prints, T.U64)
        self.by_size: dict[int, np.ndarray] = {}
        sizes = np.array(self.size)
        for n in set(self.size) - {0}:
            self.by_size[n] = np.flatnonzero(sizes == n)
        #: by shingle length: sorted shingles, a bit map of them, and the item sizes of each
        self.grams = {}
        for k in {min(words, n) for n in self.by_size}:
            where = defaultdict(set)
            for bag, n in zip(self.bags, self.size, strict=True):
                if n and min(words, n) == k:
                    for g in bag:
                        where[g].add(n)
            known = np.array(sorted(where), T.U64)
            bits = np.zeros(_BITS, bool)
            bits[(known & T.U64(_BITS - 1)).astype(np.int64)] = True
            self.grams[k] = (known, bits, where)
        self.tables = {n: self._tables(self.prints[at]) for n, at in self.by_size.items()}

    def _cuts(self) -> list[tuple[int, int]]:
        edges = np.linspace(0, 64, self.blocks + 1).astype(int)
        return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:], strict=False)]

    def _tables(self, prints: np.ndarray) -> list[np.ndarray]:
        """By block and block value: which items are within radius // blocks flips of it."""
        out = []
        for shift, width in self._cuts():
            value = (prints >> T.U64(shift)) & T.U64((1 << width) - 1)
            hit = np.zeros((1 << width, len(prints)), bool)
            for flips in range(self.radius // self.blocks + 1):
                for at in combinations(range(width), flips):
                    hit[(value ^ T.U64(sum(1 << b for b in at))).astype(np.int64), np.arange(len(prints))] = True
            out.append(hit)
        return out

    def near(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of size n within the radius."""
        any_block = np.zeros((len(prints), len(self.by_size[n])), bool)
        for (shift, width), hit in zip(self._cuts(), self.tables[n], strict=True):
            any_block |= hit[((prints >> T.U64(shift)) & T.U64((1 << width) - 1)).astype(np.int64)]
        w, i = np.nonzero(any_block)
        items = self.by_size[n][i]
        close = np.bitwise_count(prints[w] ^ self.prints[items]) <= self.radius
        return w[close], items[close]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    data = normal(data)
    words = T.word_spans(data, offsets)
    return np.split(T.hash_spans(T.prefix(data), words.start, words.end), words.first[1:-1])


def _document(index: Index, h: np.ndarray, hits: dict[int, np.ndarray], p: int, q: int):
    """Best window (item, start, sum of least, sum of greatest) of each item that the document holds."""
    best: dict[int, tuple] = {}
    for k, at in hits.items():
        _, _, where = index.grams[k]
        grams = T.combine(h, k)
        starts = defaultdict(set)
        for pos in at.tolist():
            for n in where.get(int(grams[pos]), ()):
                last = max(0, len(h) - n)
                starts[n].update(range(max(0, pos - n + k), min(pos, last) + 1) or (last,))
        for n, own in starts.items():
            own = np.array(sorted(own))
            width = min(n, len(h)) - k + 1
            lo = own[0]
            total = np.zeros((own[-1] + width - lo + 1, 64), np.int32)
            np.cumsum(_signs(grams[lo : own[-1] + width]), axis=0, out=total[1:])
            prints = _pack(total[own + width - lo] - total[own - lo])
            for w, item in zip(*(x.tolist() for x in index.near(n, prints)), strict=True):
                bag, start = index.bags[item], int(own[w])
                mine = Counter(grams[start : start + width].tolist())
                least = sum(min(c, bag[g]) for g, c in mine.items() if g in bag)
                most = width + n - k + 1 - least
                if least * q >= most * p and (item not in best or (-least * best[item][2], start) < (-best[item][1] * most, best[item][0])):
                    best[item] = (start, least, most)
    return best


def _scan(shared, p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for row, data, offsets in T.chunks(batch.column(1)):
                data = normal(data)
                words = T.word_spans(data, offsets)
                h = T.hash_spans(T.prefix(data), words.start, words.end)
                hits: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
                for k, (known, bits, _) in index.grams.items():
                    grams = T.combine(h, k)
                    at = np.flatnonzero(bits[(grams & T.U64(_BITS - 1)).astype(np.int64)])
                    at = at[known[np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)] == grams[at]]
                    owner = np.searchsorted(words.first, at, "right") - 1
                    inside = at + k <= words.first[owner + 1]
                    at, owner = at[inside], owner[inside]
                    for r in np.unique(owner).tolist():
                        hits[r][k] = at[owner == r] - words.first[r]
                rows, found = [], []
                for r in sorted(hits):
                    own = _document(index, h[words.first[r] : words.first[r + 1]], hits[r], p, q)
                    rows += [row + r] * len(own)
                    found += [(i, s, index.size[i], least / most) for i, (s, least, most) in sorted(own.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(rows)),
                            pa.array([f[0] for f in found], pa.int64()),
                            pa.array([f[1] for f in found], pa.int64()),
                            pa.array([f[2] for f in found], pa.int64()),
                            pa.array([f[3] for f in found], pa.float64()),
                        ],
                        ["key", "place", "start", "size", "similarity"],
                    )

    return run


def _names(spark: SparkSession, keys: list, kind: DataType) -> DataFrame:
    """(place, name) of the keys. Numbers and strings go as Arrow: a list is read by Python workers of its own, which stay for a minute."""
    if isinstance(kind, (IntegralType, StringType)):
        own = pa.table({"place": pa.array(range(len(keys)), pa.int64()), "name": pa.array(keys, to_arrow_type(kind))})
        return spark.createDataFrame(own)
    return spark.createDataFrame(list(enumerate(keys)), f"place bigint, name {kind.simpleString()}")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    words: int = 5,
    p: int = 8,
    q: int = 10,
    radius: int = 20,
    blocks: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row (key, item key, start_word, n_words, similarity) per document and item that it holds.

    The row is the most similar window, the first of equals; its similarity is p/q or more. A document
    shorter than an item is one window. An item of fewer words than a shingle is one shingle; an item
    without words, or with a null text, is in no document. Repeated rows of docs give repeated rows,
    repeated items a row each. Empty tables give an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kinds = source.schema["key"].dataType.simpleString(), items.schema[item_key].dataType
    out, block = None, []
    rows = items.select(F.col(item_key), F.col(item_text).cast("string")).toLocalIterator(prefetchPartitions=True)
    more = True
    while more:
        block = [tuple(r) for _, r in zip(range(ITEMS), rows, strict=False)]
        more = len(block) == ITEMS
        if not block and out is not None:
            break
        index = spark.sparkContext.broadcast(Index(block, words, radius, blocks))
        names = _names(spark, [b[0] for b in block], kinds[1])
        found = source.mapInArrow(
            _scan(index, p, q), f"key {kinds[0]}, place bigint, start bigint, size bigint, similarity double"
        )
        found = found.join(F.broadcast(names), "place").select(
            F.col("key").alias(key), F.col("name").alias(item_key), F.col("start").alias("start_word"),
            F.col("size").alias("n_words"), "similarity",
        )
        out = found if out is None else out.unionAll(found)
    return out
