"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes, and sets are cut along it.

* Candidates. A set of n n-grams lacks at most e = n(q - p) div q of them in a set that has Jaccard
  similarity p/q or more with it. Its first fragment is its first e + m n-grams, m = n div SPARE. Of
  two similar sets the first fragments share m n-grams at least (m of the smaller set): the m-th
  common n-gram has fewer than m common and at most e other n-grams before it. So the n-grams of
  first fragments are counted once, and a set that shares fewer than m of its own with any others
  leaves before anything is compared. For the sets that stay all n-grams are counted; a set of which
  fewer than n - e are in others leaves too, as documents with a common passage do. From then on the
  global order is that of these counts, least frequent n-grams first (ties by hash), and similar
  sets share one of their first e + 1 n-grams.
* Counting. For a pair to be verified the overlap is counted in each of FRAGMENTS coarse fragments
  separately, and summed per pair. Before that, each set has a parity map of about a bit an n-gram:
  two maps differ in no more bits than the sets in n-grams, so a pair whose maps differ in too many
  bits isn't similar and is not counted.

Groups that share an n-gram are never expanded into pairs. Each group elects as its centre the set
that has most of its n-grams in common with others, and each member is compared with the
centre. Two members x and y of a group of three or more that aren't both linked to the centre c can
still be similar; |x ^ y| = |(x ^ c) ^ (y ^ c)|, so they are found by a prefix and position filter
over their differences from the centre, least frequent n-grams first, which are short and hardly
shared between unrelated members.

Hot n-grams: what is grouped is pre-aggregated before the shuffle, and what is joined by n-gram or
centre are rows of a few longs in sort-merge joins, which adaptive execution splits where one key
is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.llm import _text as T
from snapweave.llm._tables import BROADCAST_ROWS, checkpoint, components, join_counted, maybe_broadcast, written

#: One n-gram of SPARE is added to the first fragment in hash order, and has to be shared there.
SPARE = 10
#: Parity maps that may be broadcast, after their bytes were summed.
BROADCAST_BYTES = 4 << 20
#: Coarse fragments in which overlaps are counted.
FRAGMENTS = 8
_ODD = T.U64(0xA24BAED4963EE407)


def _set_id(h: np.ndarray) -> int:
    """Identity of a set: equal sets, and only they, have it."""
    with np.errstate(over="ignore"):
        return int(T.mix((T.mix(h).sum(dtype=T.U64) * _ODD + T.U64(len(h))).reshape(1))[0].view(np.int64))


def _parity(h: np.ndarray) -> bytes:
    """For each of 2**k >= len(h) values of the low bits: whether an odd number of n-grams have it."""
    size = 1 << max(6, (len(h) - 1).bit_length())
    odd = np.bincount((h & T.U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """Bits in which two parity maps differ, the longer folded to the shorter's length: at most |a ^ b|."""
    x, y = (np.frombuffer(m, T.U64) for m in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(m.reshape(-1, n), axis=0) for m in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _possible(p: int, q: int):
    """The column `near` of pairs (u, un, v, vn, umap, vmap): whether their maps let them be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, un, v, vn, one, two = batch.columns
            room = (un.to_numpy() + vn.to_numpy()) * (q - p) // (p + q)
            apart = np.array([_differ(a, b) for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([u, un, v, vn, pa.array(apart <= room)], ["u", "un", "v", "vn", "near"])

    return run


def _first(h: np.ndarray, p: int, q: int) -> np.ndarray:
    """The first fragment of a sorted set."""
    return h[: len(h) * (q - p) // q + max(1, len(h) // SPARE)]


def _describe(words: int, p: int, q: int):
    """(key, n, cls, parity, text_id, grams) of each row; grams are those of the first fragment, null where a task has met the set before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            for row, data, offsets in T.chunks(batch.column(2)):
                sets = T.shingle_sets(data, offsets, words)
                ids = [_set_id(s) for s in sets]
                first, maps = [], []
                for c, s in zip(ids, sets, strict=True):
                    new = c not in met and len(s) > 0
                    met.add(c)
                    first.append(_first(s, p, q).view(np.int64) if new else None)
                    maps.append(_parity(s) if new else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(ids, pa.int64()),
                        pa.array(maps, pa.binary()),
                        batch.column(1).slice(row, len(sets)),
                        pa.array(first, pa.list_(pa.int64())),
                    ],
                    ["key", "n", "cls", "parity", "text_id", "grams"],
                )

    return run


def _sets(words: int):
    """(cls, f, part) of each set, fragment by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in T.chunks(batch.column(0)):
                sets = T.shingle_sets(data, offsets, words)
                part = []
                for s in sets:
                    part += np.split(s, np.searchsorted(s, np.arange(1, FRAGMENTS, dtype=T.U64) << T.U64(61)))
                ids = np.repeat(np.array([_set_id(s) for s in sets], np.int64), FRAGMENTS)
                frag = np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(frag), T.lists(part)], ["cls", "f", "part"])

    return run


def set_links(
    docs: DataFrame, words: int, p: int, q: int, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(described, links).

    described has a row (key, n, cls) per row of docs: size and identity of its n-gram set. links has
    rows (u, v) between identities whose sets have similarity p/q or more. Every such pair is
    connected by a path of links (two sets that are linked to one centre aren't linked again).
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("text_id", F.xxhash64("text"))
    kind = source.schema["key"].dataType.simpleString()
    described = written(
        source.select("key", "text_id", "text").mapInArrow(
            _describe(words, p, q), f"key {kind}, n bigint, cls bigint, parity binary, text_id bigint, grams array<bigint>"
        ),
        "sets",
    )
    first = described.filter("grams is not null")
    grams = first.select("cls", "n", F.explode("grams").alias("g"))
    # n-grams that the first fragments of two sets have; a hot one is counted before the shuffle
    shared = grams.groupBy("g").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("g")
    # a set that shares fewer than similar sets do has no partner
    sharing = (
        grams.join(shared, "g").groupBy("cls", "n").agg(F.size(F.collect_set("g")).alias("own"))
        .filter(f"own >= greatest(1, ((n * {p} + {q - 1}) div {q}) div {SPARE})")
    )
    about = first.groupBy("cls").agg(F.min(F.struct("text_id", "parity")).alias("about"))
    some = written(sharing.join(about, "cls").select("cls", "n", "about.*"), "some")
    # the texts of these sets alone are cut into words again
    number = some.count()
    wanted = maybe_broadcast(some.select("text_id").distinct(), number)
    texts = source.select("text_id", "text").join(wanted, "text_id", "left_semi").dropDuplicates(["text_id"]).select("text")
    parts = written(texts.mapInArrow(_sets(words), "cls bigint, f int, part array<bigint>"), "parts")
    every = parts.select("cls", F.explode("part").alias("g"))
    df = every.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = every.join(df, "g").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("all"))
    members = written(
        some.join(ordered, "cls")
        .withColumn("room", F.expr(f"n * {q - p} div {q} + 1 - (n - size(all))"))
        .filter("room > 0")
        .select("cls", "n", "parity", F.expr("size(all) * 1000000L div n").alias("weight"), F.slice("all.g", 1, F.col("room").cast("int")).alias("grams")),
        "members",
    )
    # each n-gram's centre: the set that shares most of its own
    held = members.select("cls", "weight", F.explode("grams").alias("g"))
    centres = held.groupBy("g").agg(F.count("*").alias("company"), F.max(F.struct("weight", "cls")).alias("top")).filter("company > 1")
    groups = written(
        held.join(centres, "g").select("g", F.col("top.cls").alias("c"), F.col("cls").alias("x"), "company").filter("c <> x"), "groups"
    )
    maps = members.select("cls", "n", "parity")
    held, size = maps.agg(F.count("*"), F.coalesce(F.sum(F.length("parity")), F.lit(0))).first()
    if size <= BROADCAST_BYTES:
        maps = maybe_broadcast(maps, held)

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) with their sizes, and whether their parity maps let them be similar."""
        sided = pairs.join(maps.toDF("v", "vn", "vmap"), "v").join(maps.toDF("u", "un", "umap"), "u")
        return sided.select("u", "un", "v", "vn", "umap", "vmap").mapInArrow(_possible(p, q), "u bigint, un bigint, v bigint, vn bigint, near boolean")

    stars = written(possible(groups.select(F.col("c").alias("u"), F.col("x").alias("v")).distinct()).toDF("c", "cn", "x", "xn", "near"), "stars")
    compares = stars.count()
    close = stars.filter("near")
    many = groups.filter("company > 2")
    if held <= BROADCAST_ROWS:
        parts = parts.join(maybe_broadcast(members.select("cls"), held), "cls", "left_semi")
    left = parts.select(F.col("cls").alias("c"), "f", F.col("part").alias("cp"))
    right = parts.select(F.col("cls").alias("x"), "f", F.col("part").alias("xp"))

    def apart(pairs: DataFrame) -> DataFrame:
        """Fragment by fragment, the difference of x from its centre."""
        diff = F.concat(F.array_except("xp", "cp"), F.array_except("cp", "xp"))
        return maybe_broadcast(pairs, compares).join(right, "x").join(left, ["c", "f"]).select(*pairs.columns, "f", diff.alias("diff"))

    compared = checkpoint(
        apart(close.select("c", "cn", "x", "xn"))
        .groupBy("c", "x", "cn", "xn")
        .agg(F.sum(F.size("diff")).alias("d"))
        .filter(F.col("d") * (p + q) <= (F.col("cn") + F.col("xn")) * (q - p))
        .select("c", "x")
        .withColumn("near", F.lit(True))
    )
    # members that are not linked to a centre, against its other members in the groups that they share
    told = many.join(maybe_broadcast(compared, compares), ["c", "x"], "left").select("g", "c", "x", F.coalesce("near", F.lit(False)).alias("near"))
    unsure = told.filter("not near").select("g").distinct()
    again = told.join(maybe_broadcast(unsure, groups.count()), "g", "left_semi").select("c", "x", "near").distinct()
    again = maybe_broadcast(stars.select("c", "x", "xn"), compares).join(again, ["c", "x"])
    delta = written(apart(again).select("c", "x", "xn", "near", F.explode("diff").alias("g")), "differences")
    df = delta.groupBy("c", "g").agg(F.count("*").alias("df")).filter("df > 1")
    allowed = F.expr(f"(xn + floor(xn * {q} / {p})) * {q - p} div {p + q}")
    ranked = (
        # a gram in one difference only takes a place in the prefix but joins with nothing
        delta.join(df, ["c", "g"], "left")
        .withColumn("df", F.coalesce("df", F.lit(1)))
        .groupBy("c", "x", "xn", "near")
        .agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("all"))
        .select("c", "x", "xn", F.size("all").alias("d"), "near", F.posexplode(F.slice("all", 1, (allowed + 1).cast("int"))).alias("pos", "e"))
        .filter("e.df > 1")
        .select("c", "x", "xn", "d", "near", "pos", F.col("e.g").alias("g"))
    )
    # sets that are linked to one centre have its label: pairs of one label aren't listed
    label = maybe_broadcast(compared.groupBy("x").agg(F.min("c").alias("label")), compares)
    ranked = written(
        ranked.join(label, "x", "left").withColumn("label", F.when(F.col("near"), F.col("c")).otherwise(F.coalesce("label", "x"))).drop("near"), "ranked"
    )
    # the places of the first common n-gram sum to the room at most, so one of them is in the first half of it
    heads = ranked.filter(F.col("pos") * 2 <= allowed)
    # per label the first place and the least and greatest number of differences: most labels of a hot n-gram can't meet
    reach = ranked.groupBy("c", "g", F.col("label").alias("other")).agg(F.min("pos").alias("opos"), F.min("d").alias("dlow"), F.max("d").alias("dhigh"))
    across = (
        heads.groupBy("c", "g", "label").agg(F.min("pos").alias("first"), F.max(allowed).alias("most"))
        .join(reach, ["c", "g"])
        .filter("label <> other and first + opos <= most")
        .drop("first", "most")
    )
    other = ranked.select(
        "c", "g", F.col("label").alias("other"), F.col("x").alias("y"), F.col("xn").alias("yn"), F.col("d").alias("yd"), F.col("pos").alias("ypos")
    )
    room = f"(xn + yn) * {q - p} div {p + q}"
    pairs = (
        heads.withColumn("most", allowed)
        .join(across, ["c", "g", "label"])
        .filter("pos + opos <= most and dlow - d <= most and d - dhigh <= most")
        .join(other, ["c", "g", "other"])
        .filter(f"x <> y and pos + ypos <= {room} and abs(d - yd) <= {room}")
        .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
        .distinct()
    )
    pairs = possible(pairs).filter("near").select("u", "un", "v", "vn")
    one = parts.select(F.col("cls").alias("u"), "f", F.col("part").alias("up"))
    two = parts.select(F.col("cls").alias("v"), "f", F.col("part").alias("vp"))
    found = (
        pairs.join(one, "u")
        .join(two, ["v", "f"])
        .groupBy("u", "v", "un", "vn")
        .agg(F.sum(F.size(F.array_intersect("up", "vp"))).alias("both"))
        .filter(f"(un + vn - 2 * both) * {p + q} <= (un + vn) * {q - p}")
        .select("u", "v")
    )
    links = compared.select(F.col("c").alias("u"), F.col("x").alias("v")).union(found).distinct()
    return described.select("key", "n", "cls"), links


def jaccard_components(
    docs: DataFrame, words: int = 5, p: int = 8, q: int = 10, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row (key, n_shingles, component_id) per row of docs.

    Two documents link when their sets of word shingles have Jaccard similarity p/q or more; the
    component is the least key that links reach. A document of fewer words is one shingle, all its
    words; a document without words, or a null text, has no shingle, links with nothing and is its own
    component. Repeated rows are equal sets and link. A null key takes part but is never the least; its
    component is null if no other key is reached. An empty table gives an empty table. Other columns
    are not read.
    """
    described, links = set_links(docs, words, p, q, key, text)
    label = components(links).withColumnRenamed("node", "cls")
    rows = described.join(maybe_broadcast(label), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    rows = checkpoint(rows.select("key", "n", "component"))
    least = checkpoint(rows.filter("n > 0").groupBy("component").agg(F.min("key").alias("least"), F.count("*").alias("times")))
    return (
        join_counted(rows.filter("n > 0"), least, "component")
        .select("key", "n", "least")
        .union(rows.filter("n = 0").select("key", "n", "key"))
        .toDF(key, "n_shingles", "component_id")
    )
