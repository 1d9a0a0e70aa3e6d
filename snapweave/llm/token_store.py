"""Token ids in a binary format: static range asymmetric numeral system, interleaved blocks.

Documents are dealt by ranges of their key, so that file p holds smaller keys than file p + 1, and
are tokenised in that order. A file is a run of segments of about SEGMENT ids. A segment has one
frequency table that all its blocks share, and blocks of whole documents of about BLOCK ids each. A
block is coded by LANES interleaved coders: id i of a block belongs to lane i mod LANES. Every lane
has a checkpoint (its final state and the number of its 32-bit words), so blocks, and the lanes of a
block, decode independently; each block has a crc32 of its payload.

Coder: 64-bit state x in [2**31, 2**63), frequencies that sum to 2**20, 32-bit renormalisation.
    encode s: while x >= (2**31 >> 20 << 32) * f[s]: emit low 32 bits; x = x // f[s] << 20 | c[s] + x % f[s]
    decode:   s = symbol of x mod 2**20; x = f[s] * (x >> 20) + x mod 2**20 - c[s]; below 2**31 take 32 bits

The files are a Parquet dataset, one row a segment: `part` and `segment`; its table (`symbols`,
`frequencies`); `keys` and `lengths` of its documents; `documents`, `bytes` and `crc32` of each block;
`states` and `words` of each lane, block by block; and `payload`, the blocks' words one after another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapweave.llm import _text as T
from snapweave.llm._tables import maybe_broadcast, small_batches

SEGMENT, BLOCK, LANES = 1 << 21, 1 << 15, 64
_SCALE = 20
_LOW = np.uint64(1 << 31)
_U = np.uint64

#: Pieces whose ids a worker remembers; beyond that those that were used once are forgotten.
_PIECES = 600_000
#: Bytes of text that are cut into pieces at once.
_CUT = T.CHUNK // 4
_OTHER, _TAIL = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte, and by the byte after 0xC3: letters whose lower case is one letter and that no
    normalisation changes; and ASCII punctuation that begins no contraction."""
    ascii_letter, latin, tail = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    for c in range(33, 127):
        (ascii_letter if chr(c).isalpha() else tail)[c] = True
    tail[ord("'")] = False
    tail[ord("0") : ord("9") + 1] = False
    latin[0x80:0xC0] = True
    latin[[0x97, 0xB7]] = False
    return ascii_letter, latin, tail


_LETTER, _LATIN, _PUNCTUATION = _classes()


class Encoder:
    """Ids of whole texts, by pieces that are encoded once and remembered.

    Text between ASCII white space is encoded on its own: the tokenizer drops white space before it
    splits, and none of its patterns crosses it. A word of letters and then punctuation is two pieces,
    which the tokenizer splits too; letters are looked up in lower case. Any other word is one piece.
    Pieces are cut, hashed, found in an open hash table and put together in numpy, a chunk of texts at
    once. Where a tokenizer splits a sample of words otherwise, every word is one piece.
    """

    def __init__(self, path: str, pieces: int = _PIECES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.most = pieces
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
        self.mapped = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self._forget()
        self.split = True
        sample = ["The", "ÉCOLE", "straße", "Ölung", "unbelievableness", "x", "ÿÿ"]
        tails = ["", ".", "!?", "),", "-(", '"', "$%&", "..."]
        words = [w + t for w in sample for t in tails]
        whole = self._each(words)
        parts = [self._letters([w])[0] + self._each([t])[0] for w in (x.lower() for x in sample) for t in tails]
        self.split = whole == parts

    def _forget(self) -> None:
        """Starts again with the pieces that were used more than once, the most used half at most."""
        keep = np.zeros(0, np.int64)
        if getattr(self, "count", 0):
            often = np.flatnonzero(self.uses[: self.count] > 1)
            keep = often[np.argsort(-self.uses[often], kind="stable")[: self.most // 2]]
        known = sizes = ids = np.zeros(0, np.int64)
        if len(keep):
            known, sizes = self.hashes[keep], self.size[keep]
            ids = self.pool[np.repeat(self.at[keep] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        room = self.most + 1
        self.table = np.full(1 << 10, -1, np.int32)
        self.hashes, self.at, self.size, self.uses = np.zeros(room, _U), np.zeros(room, np.int64), np.zeros(room, np.int32), np.zeros(room, np.int64)
        self.pool, self.used, self.count = np.zeros(1 << 16, self.dtype), 0, 0
        self._remember(known, sizes, ids)

    def _remember(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Pieces with their numbers of ids, and the ids of all of them one after another."""
        if not len(hashes):
            return
        n, end = len(sizes), self.count + len(sizes)
        if end > len(self.size):
            more = end + end // 2 - len(self.size)
            self.hashes, self.at, self.size, self.uses = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.hashes, self.at, self.size, self.uses))
        total = len(ids)
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), self.dtype)])
        self.pool[self.used : self.used + total] = ids
        self.at[self.count : end] = self.used + np.cumsum(sizes) - sizes
        self.size[self.count : end], self.hashes[self.count : end] = sizes, hashes
        self.used, self.count = self.used + total, self.count + n
        new = np.arange(end - n, end)
        if 4 * end > 3 * len(self.table):
            self.table, new = np.full(1 << (2 * end).bit_length(), -1, np.int32), np.arange(end)
        self._enter(new)

    def _enter(self, places: np.ndarray) -> None:
        """Places of pieces that the table doesn't have yet: each in the first free slot from its hash on."""
        slot = self._slots(self.hashes[places])
        while len(places):
            free = self.table[slot] < 0
            self.table[slot[free]] = places[free]
            left = self.table[slot] != places
            places, slot = places[left], (slot[left] + 1) % len(self.table)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the pieces with these hashes; -1 where there is none."""
        slot = self._slots(hashes)
        place = self.table[slot].astype(np.int64)
        on = np.flatnonzero((place >= 0) & (self.hashes[place] != hashes))
        while len(on):
            slot[on] = (slot[on] + 1) % len(self.table)
            own = place[on] = self.table[slot[on]]
            on = on[(own >= 0) & (self.hashes[own] != hashes[on])]
        return place

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & _U(len(self.table) - 1)).astype(np.int64)

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _letters(self, runs: list[str]) -> list[list[int]]:
        """Ids of runs of lower-case letters, each one word of the tokenizer's model."""
        cut = self.tokenizer.model.tokenize
        return [[t.id for t in cut(x if x.isascii() else x.translate(self.mapped))] for x in runs]

    def _known(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray, learn) -> np.ndarray:
        """Places of pieces; those of new ones after they are learned."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        some, first, back, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        place = self._find(some)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = data.tobytes()
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)
            place[new] = self.count + np.arange(len(new))
            ids = learn([raw[a:b].decode() for a, b in spans])
            sizes = np.array([len(x) for x in ids], np.int64)
            self._remember(some[new], sizes, np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes.sum())))
        self.uses[place] += times
        return place[back]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of a chunk of texts, each with end_id after it."""
        if self.count > self.most:
            self._forget()
        words = T.word_spans(data, offsets)
        start, end = words.start, words.end
        n, docs = len(start), len(offsets) - 1
        lower = data
        middle = start
        simple = np.zeros(n, bool)
        if self.split and n:
            after = np.zeros(len(data), bool)
            after[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
            letter = _LETTER[data] | after
            letter[:-1] |= after[1:]
            lower = T.lower(data)
            lower = np.where(after & (data < 0x9F), data + np.uint8(32), lower)
            sums = np.concatenate([[0], np.cumsum(letter)])
            tails = np.concatenate([[0], np.cumsum(_PUNCTUATION[data])])
            held = sums[end] - sums[start]
            middle = start + held
            simple = (held > 0) & (sums[middle] - sums[start] == held) & (held + tails[end] - tails[start] == end - start)
        # each word's two places, and one at the end of each text
        slots = np.full(2 * n + docs, -1, np.int64)
        own = 2 * np.arange(n) + words.row
        at = np.flatnonzero(simple)
        pre = T.prefix(lower)
        slots[own[at]] = self._known(T.hash_spans(pre, start[at], middle[at]), start[at], middle[at], lower, self._letters)
        at = np.flatnonzero(simple & (middle < end))
        slots[own[at] + 1] = self._known(T.hash_spans(pre, middle[at], end[at]) ^ _TAIL, middle[at], end[at], data, self._each)
        at = np.flatnonzero(~simple)
        if len(at):
            raw = T.hash_spans(T.prefix(data), start[at], end[at]) ^ _OTHER
            slots[own[at]] = self._known(raw, start[at], end[at], data, self._each)
        last = 2 * words.first[1:] + np.arange(docs)
        size = np.where(slots >= 0, self.size[slots], 0)
        size[last] = 1
        ends = np.cumsum(size)
        move = np.repeat(np.where(slots >= 0, self.at[slots], 0) - (ends - size), size)
        ids = self.pool[move + np.arange(len(move))].astype(np.uint32)
        ids[ends[last] - 1] = end_id
        return ids, np.diff(np.concatenate([[0], ends[last]]))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): each at least 1, in sum 2**20."""
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    count = count[symbols]
    f = 1 + count * ((1 << _SCALE) - len(symbols)) // count.sum()
    f[np.argmax(f)] += (1 << _SCALE) - f.sum()
    return symbols, f


def encode_blocks(blocks: list[np.ndarray], symbols: np.ndarray, f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bytes]]:
    """(states, words, payload) of each block; all lanes of all blocks step together."""
    size = int(symbols[-1]) + 1
    freq, low = np.zeros(size, _U), np.zeros(size, _U)
    freq[symbols] = f
    low[symbols] = np.cumsum(f) - f
    lanes = len(blocks) * LANES
    sizes = np.array([len(b) for b in blocks], np.int64)
    held, lane = np.repeat(sizes, LANES), np.tile(np.arange(LANES), len(blocks))
    # step k of a lane is LANES further in its own block: no padding to the longest block
    flat, place = np.concatenate(blocks), np.repeat(np.cumsum(sizes) - sizes, LANES) + lane
    x = np.full(lanes, _LOW)
    who, what = [], []
    for k in range(-(-int(sizes.max()) // LANES) - 1, -1, -1):
        at = np.flatnonzero(k * LANES + lane < held)
        s, y = flat[place[at] + k * LANES], x[at]
        fs = freq[s]
        full = np.flatnonzero(y >= fs << _U(31 - _SCALE + 32))
        if len(full):
            who.append(at[full])
            what.append(y[full].astype(np.uint32))
            y[full] >>= _U(32)
        d = y // fs
        x[at] = (d << _U(_SCALE)) + (y - d * fs) + low[s]
    who = np.concatenate(who) if who else np.zeros(0, np.int64)
    what = np.concatenate(what) if what else np.zeros(0, np.uint32)
    words = np.bincount(who, minlength=lanes)
    # a lane's words stand in the order in which the decoder takes them, the last emitted first
    stream = what[::-1][np.argsort(who[::-1], kind="stable")]
    edges = np.concatenate([[0], np.cumsum(words)])
    return [
        (x[i * LANES : (i + 1) * LANES], words[i * LANES : (i + 1) * LANES], stream[edges[i * LANES] : edges[(i + 1) * LANES]].astype("<u4").tobytes())
        for i in range(len(blocks))
    ]


def decode_blocks(coded: list[tuple[np.ndarray, np.ndarray, bytes]], lengths: list[int], symbols: np.ndarray, f: np.ndarray) -> list[np.ndarray]:
    """The ids of blocks of one segment."""
    slot = np.repeat(np.arange(len(symbols)), f)
    freq, low = f.astype(_U), (np.cumsum(f) - f).astype(_U)
    held, lane = np.repeat(lengths, LANES), np.tile(np.arange(LANES), len(coded))
    x = np.concatenate([c[0] for c in coded]).astype(_U)
    words = np.concatenate([c[1] for c in coded])
    at = np.cumsum(words) - words
    stream = np.frombuffer(b"".join(c[2] for c in coded) + b"\0\0\0\0", "<u4")
    sizes = np.array(lengths, np.int64)
    ends = np.cumsum(sizes)
    flat, place = np.zeros(ends[-1], np.int32), np.repeat(ends - sizes, LANES) + lane
    mask = _U((1 << _SCALE) - 1)
    for k in range(-(-int(sizes.max()) // LANES)):
        on = np.flatnonzero(k * LANES + lane < held)
        y = x[on]
        part = y & mask
        s = slot[part.astype(np.int64)]
        flat[place[on] + k * LANES] = s
        y = freq[s] * (y >> _U(_SCALE)) + part - low[s]
        short = np.flatnonzero(y < _LOW)
        if len(short):
            take = on[short]
            y[short] = (y[short] << _U(32)) | stream[at[take]]
            at[take] += 1
        x[on] = y
    if (x != _LOW).any():
        raise ValueError("a lane doesn't end in its first state")
    return np.split(symbols[flat], ends[:-1])


_TYPES = {
    "part": pa.int32(), "segment": pa.int32(), "symbols": pa.list_(pa.int32()), "frequencies": pa.list_(pa.int32()),
    "lengths": pa.list_(pa.int64()), "documents": pa.list_(pa.int32()), "bytes": pa.list_(pa.int64()),
    "crc32": pa.list_(pa.int64()), "states": pa.list_(pa.int64()), "words": pa.list_(pa.int32()), "payload": pa.binary(),
}
_SEGMENTS = (
    "part int, segment int, symbols array<int>, frequencies array<int>, lengths array<bigint>, documents array<int>, "
    "bytes array<bigint>, crc32 array<bigint>, states array<bigint>, words array<int>, payload binary, keys array<{}>"
)


def _write(path: str, end_id: int):
    def flush(part: int, segment: int, keys: list, docs: list[np.ndarray], kind: pa.DataType):
        flat = np.concatenate(docs)
        symbols, f = frequencies(flat)
        ends = np.cumsum([0, *map(len, docs)])
        cuts, total = [0], 0
        for i, d in enumerate(docs):
            total += len(d)
            if total >= BLOCK or i == len(docs) - 1:
                cuts.append(i + 1)
                total = 0
        coded = encode_blocks([flat[ends[a] : ends[b]] for a, b in zip(cuts, cuts[1:], strict=False)], symbols, f)
        row = {
            "part": part,
            "segment": segment,
            "symbols": symbols.astype(np.int32),
            "frequencies": f.astype(np.int32),
            "lengths": [len(d) for d in docs],
            "documents": np.diff(cuts).tolist(),
            "bytes": [len(c[2]) for c in coded],
            "crc32": [zlib.crc32(c[2]) for c in coded],
            "states": np.concatenate([c[0] for c in coded]).view(np.int64),
            "words": np.concatenate([c[1] for c in coded]).astype(np.int32),
            "payload": b"".join(c[2] for c in coded),
        }
        columns = [pa.array([row[n]], t) for n, t in _TYPES.items()]
        return pa.RecordBatch.from_arrays([*columns, pa.array([keys], pa.list_(kind))], [*_TYPES, "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        segment, keys, docs, held = 0, [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, data, offsets in T.chunks(batch.column(1), _CUT):
                ids, sizes = encode(data, offsets, end_id)
                for i, own in enumerate(np.split(ids, np.cumsum(sizes)[:-1])):
                    keys.append(names[row + i])
                    docs.append(own)
                    held += len(own)
                    if held >= SEGMENT:
                        yield flush(part, segment, keys, docs, batch.schema.field(0).type)
                        segment, keys, docs, held = segment + 1, [], [], 0
                        T.trim()
        if docs:
            yield flush(part, segment, keys, docs, batch.schema.field(0).type)

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents to the folder in ascending order of key, nulls first.

    A null text is empty; every document ends with end_id. Rows of one key stand in the order of
    their texts. tokenizer is the path of a tokenizers file that every executor can read. An empty
    table writes a dataset without rows. Other columns are not read.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    dealt = source.repartitionByRange("key").sortWithinPartitions("key", "text")
    with small_batches(docs.sparkSession):
        dealt.mapInArrow(_write(tokenizer, end_id), _SEGMENTS.format(kind)).write.parquet(folder)


def decode_segment(r: dict) -> list[np.ndarray]:
    """The ids of each block of a stored segment, after its checksums."""
    coded, lengths, at, doc = [], [], 0, 0
    states, words = np.array(r["states"], np.int64).view(_U), np.array(r["words"], np.int64)
    for i, (size, crc, held) in enumerate(zip(r["bytes"], r["crc32"], r["documents"], strict=True)):
        payload = r["payload"][at : at + size]
        if zlib.crc32(payload) != crc:
            raise ValueError(f"part {r['part']}, segment {r['segment']}, block {i}: the payload's crc32 is wrong")
        lanes = slice(i * LANES, (i + 1) * LANES)
        coded.append((states[lanes], words[lanes], payload))
        lengths.append(sum(r["lengths"][doc : doc + held]))
        at, doc = at + size, doc + held
    return decode_blocks(coded, lengths, np.array(r["symbols"]), np.array(r["frequencies"]))


def _read(keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                raw = np.concatenate(decode_segment(r)).astype("<u4")
                lengths = np.array(r["lengths"])
                ends = np.cumsum(lengths)
                spans = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                columns = [
                    pa.array(r["keys"], batch.schema.field("keys").type.value_type),
                    pa.array([r["part"]] * len(spans), pa.int32()),
                    pa.array([r["segment"]] * len(spans), pa.int32()),
                    pa.array([a for a, _ in spans], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in spans], pa.int64()),
                ]
                T.trim()
                names = ["key", "part", "segment", "at", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([raw[a:b].astype(np.int64) for a, b in spans], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read(spark: SparkSession, folder: str, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row (key, start, n_tokens, ids_crc32[, ids]) per document of a written folder.

    start counts the ids of all documents before it. A block whose crc32 is wrong, or a lane that
    doesn't decode to its first state, is an error.
    """
    rows = spark.read.parquet(folder)
    sizes = rows.select("part", "segment", F.expr("aggregate(lengths, 0L, (a, b) -> a + b)").alias("size"))
    # a total per file, then per segment within the file: no window over all segments
    files = sizes.groupBy("part").agg(F.sum("size").alias("total"))
    files = files.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = Window.partitionBy("part").orderBy("segment")
    offsets = (
        sizes.withColumn("offset", F.sum("size").over(within) - F.col("size"))
        .join(maybe_broadcast(files), "part")
        .select("part", "segment", (F.col("before") + F.col("offset")).alias("offset"))
    )
    kind = rows.schema["keys"].dataType.elementType.simpleString()
    schema = f"key {kind}, part int, segment int, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    # the segments' places are few; the ids of documents stay where they were decoded
    return rows.mapInArrow(_read(ids), schema).join(maybe_broadcast(offsets), ["part", "segment"]).select(
        F.col("key").alias(key), (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids
    )
