"""URL filters: rules, and gradient-boosted trees on lexical features where no rule fits.

The rules label URLs: block 1, allow 0. Histogram trees of DEPTH levels are boosted on the lexical
features of at most `most` labelled URLs, the least by hash. Statistics of the host's last label are
taken over all rows: how often it occurs, and the smoothed share of blocked labels, in SUFFIXES hash
classes, so their table has a fixed size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapweave.llm._tables import bounded

DEPTH, TREES, RATE, RIDGE, LEAST, BINS = 4, 60, 0.2, 2.0, 10, 32
SUFFIXES = 1024
MOST = 20_000
#: Shared by rule and training: 1 is block.
ACTIONS = {"block": 1, "allow": 0}
_CASE = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without "://"."""
    at = F.locate("://", url)
    after = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), *_CASE)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null if none does. At most 1000 rules."""
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules")
    rule, action = None, None
    for does, name in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, _, start = name.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        rule = rule.when(fits, name) if rule is not None else F.when(fits, name)
        action = action.when(fits, does) if action is not None else F.when(fits, does)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, action)


def suffix_class(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -1)), F.lit(SUFFIXES)).cast("int")


FEATURES = (
    "length", "host length", "path length", "depth", "labels", "digit ratio", "host digit ratio", "path digit ratio", "entropy",
    "host entropy", "parameters", "hyphens", "underscores", "percent signs", "upper case ratio", "longest segment", "mean segment",
    "last segment digits", "extension length", "fragment", "https", "longest label", "vowel ratio", "suffix frequency", "suffix rate",
    "first segment class", "first label length",
)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def lexical(url: str | None, host: str, path: str, frequency: float, rate: float) -> list[float]:
    """FEATURES of one URL; a null URL has those of an empty one."""
    url = url or ""
    digits = lambda s: sum(c.isdigit() for c in s) / (len(s) or 1)
    segments = [s for s in path.split("/") if s]
    labels = host.split(".") if host else []
    query = url.partition("#")[0].partition("?")[2]
    last = segments[-1] if segments else ""
    first = segments[0] if segments else ""
    return [
        len(url), len(host), len(path), len(segments), len(labels), digits(url), digits(host), digits(path), entropy(url),
        entropy(host), len([p for p in query.split("&") if p]), url.count("-"), url.count("_"), url.count("%"),
        sum(c.isupper() for c in url) / (len(url) or 1), max(map(len, segments), default=0), sum(map(len, segments)) / (len(segments) or 1),
        sum(c.isdigit() for c in last), len(last.rpartition(".")[2]) if "." in last else 0, "#" in url, url.startswith("https"),
        max(map(len, labels), default=0), sum(c in "aeiou" for c in host) / (len(host) or 1), frequency, rate,
        sum(ord(c) * 31**i for i, c in enumerate(first[:3])) % 997, len(labels[0]) if labels else 0,
    ]


class Boosted:
    """Gradient-boosted trees over binned features, for a logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        self.trees: list[list[tuple[int, int, float]]] = []
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        b, f = self._bins(x), np.full(len(x), self.base)
        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-f))
            tree = self._grow(b, prob - y, prob * (1 - prob))
            self.trees.append(tree)
            f += self._walk(tree, b)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        """Nodes of a full tree, as (feature, greatest bin that goes left, value)."""
        tree = [(-1, 0, 0.0)] * (2 ** (DEPTH + 1) - 1)
        node = np.zeros(len(b), np.int64)
        for at in range(len(tree)):
            own = np.flatnonzero(node == at)
            if not len(own):
                continue
            sg, sh = g[own].sum(), h[own].sum()
            tree[at] = (-1, 0, -RATE * sg / (sh + RIDGE))
            if at >= 2**DEPTH - 1 or len(own) < 2 * LEAST:
                continue
            best = (1e-6, -1, 0)
            for j in range(b.shape[1]):
                x = b[own, j]
                cg, ch, cn = (np.cumsum(np.bincount(x, w, BINS))[:-1] for w in (g[own], h[own], None))
                gain = cg**2 / (ch + RIDGE) + (sg - cg) ** 2 / (sh - ch + RIDGE) - sg**2 / (sh + RIDGE)
                gain[(cn < LEAST) | (len(own) - cn < LEAST)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                tree[at] = (best[1], best[2], 0.0)
                node[own] = 2 * at + 1 + (b[own, best[1]] > best[2])
        return tree

    @staticmethod
    def _walk(tree: list[tuple[int, int, float]], b: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
        node = np.zeros(len(b), np.int64)
        for _ in range(DEPTH):
            inner = feature[node] >= 0
            right = b[np.arange(len(b)), np.maximum(feature[node], 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        b, f = self._bins(x), np.full(len(x), self.base)
        for tree in self.trees:
            f += self._walk(tree, b)
        return 1 / (1 + np.exp(-f))


class Constant:
    def __init__(self, rate: float):
        self.rate = rate

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.rate)


def _matrix(urls: list, hosts: list, paths: list, classes: list, stats: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    rows = [lexical(u, h, p, stats[0][c], stats[1][c]) for u, h, p, c in zip(urls, hosts, paths, classes, strict=True)]
    return np.array(rows, np.float64).reshape(len(rows), len(FEATURES))


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, stats = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _matrix(*(part.column(i).to_pylist() for i in range(4)), stats)
                yield pa.RecordBatch.from_arrays([*part.columns[4:], pa.array(model.score(x))], [*part.schema.names[4:], "score"])

    return run


def judged(
    pages: DataFrame, rules: list[tuple[str, str]], most: int = MOST, key: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row (key, host, path, rule, verdict, score) per row of pages.

    verdict is the action of the longest rule that fits, else block if the trees' score is 0.5 or more.
    A null or malformed URL has an empty host and path, fits no rule and is judged by its features.
    Without labelled URLs of both kinds the score is the share of blocked ones, or 0. An empty table
    gives an empty table; other columns are not read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action, "class": suffix_class(F.col("host"))})
    y = F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0)
    suffixes = rows.groupBy("class").agg(F.count("*").alias("n"), F.sum(y).alias("bad"), F.count(y).alias("told")).collect()
    total = sum(r.n for r in suffixes) or 1
    told, bad = sum(r.told for r in suffixes), sum(r.bad or 0 for r in suffixes)
    prior = bad / told if told else 0.0
    frequency, rate = np.full(SUFFIXES, -20.0), np.full(SUFFIXES, prior)
    for r in suffixes:
        frequency[r["class"]] = math.log(r.n / total)
        rate[r["class"]] = ((r.bad or 0) + 20 * prior) / (r.told + 20)
    labelled = rows.withColumn("y", y).filter("y is not null").select("url", "host", "path", "class", "y", "key")
    sample = bounded(labelled, ["key", "url"], most, told).collect()
    stats = (frequency, rate)
    if 0 < bad < told and len({r.y for r in sample}) == 2:
        columns = [[r[i] for r in sample] for i in range(4)]
        model = Boosted(_matrix(*columns, stats), np.array([r.y for r in sample], np.float64))
    else:
        model = Constant(prior)
    shared = spark.sparkContext.broadcast((model, stats))
    kind = rows.schema["key"].dataType.simpleString()
    scored = rows.select(
        "url", "host", "path", "class", "key", F.col("host").alias("own_host"), F.col("path").alias("own_path"), "rule", "action"
    ).mapInArrow(_judge(shared), f"key {kind}, own_host string, own_path string, rule string, action string, score double")
    verdict = F.coalesce("action", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(
        F.col("key").alias(key), F.col("own_host").alias("host"), F.col("own_path").alias("path"), "rule", verdict.alias("verdict"), "score"
    )
