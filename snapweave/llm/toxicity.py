"""Toxicity by weak supervision.

1. Lexicons. Words, and the first 4, 5 and 6 bytes of longer words, are tokens. Tokens of all rows that
   may be learned from are counted; those that toxic texts have at least exp(ODDS) times as often as
   others, with a log likelihood ratio of EVIDENCE against chance, are dealt to LEXICONS lexicon
   voters. This choice, and the base rate of toxic rows, are all that true labels are used for.
2. Votes. A lexicon votes toxic where a text has one of its tokens, else abstains. Pattern voters look
   at shouting, exclamation marks, masked letters, stretched words and short lines of insults; one voter
   votes clean where no lexicon fires.
3. Label model, generative: a class is drawn by the base rate, then each voter votes by the class and
   by the vote of the voter that it depends on most. Expectation maximisation estimates these tables,
   the voters' accuracies and correlations, without labels; the dependencies are the tree of greatest
   mutual information given the class, under the posteriors, without edges that chance explains, and
   both are iterated. A voter that only repeats another adds nothing to the posterior.
4. Classifier. A logistic regression on token presence and pattern strengths is trained on the
   posterior labels of the sample, and scores every whole text: a sum over the tokens that it has.

The sample is the `most` labelled rows that are least by hash, and about EACH rows of each lexicon
token that these would have less often, so that every token gets a weight; it bounds what reaches the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.llm import _text as T
from snapweave.llm._tables import bounded, checkpoint, fold, maybe_broadcast
from snapweave.llm.decontamination import normal

MOST = 10_000
TOKENS, LEXICONS, ODDS, EVIDENCE = 600, 16, 3.0, 6.0
#: Rows of a token that the sample holds at least, about, or all if there are fewer.
EACH = 10
PREFIXES = (4, 5, 6)
_BITS = 1 << 20
PATTERNS = ("shouting", "exclamations", "masked letters", "stretched words", "short words")
#: A pattern voter votes toxic above its threshold.
THRESHOLDS = (0.5, 0.05, 0.02, 0.05, 0.9)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token) of every word and prefix, and the patterns of each row."""
    plain = normal(data)
    words = T.word_spans(plain, offsets)
    pre, row = T.prefix(plain), words.row
    size = words.end - words.start
    rows, found = [row], [T.hash_spans(pre, words.start, words.end)]
    for k in PREFIXES:
        long = size > k
        rows.append(row[long])
        start = words.start[long]
        found.append(T.mix(T.hash_spans(pre, start, start + k) + T.U64(k)))
    n = len(offsets) - 1
    bytes_of = np.diff(offsets) + 1.0
    upper = (data >= 65) & (data <= 90)
    letters = upper | ((data >= 97) & (data <= 122))
    same = np.zeros(len(data), bool)
    if len(data) > 2:
        same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letters[2:]
    per = lambda x: T.row_sums(x, offsets)
    masks = (data == ord("*")) | (data == ord("@")) | (data == ord("$"))
    short = np.bincount(row, weights=size <= 3, minlength=n)
    patterns = np.stack(
        [per(upper) / (per(letters) + 1), per(data == ord("!")) / bytes_of, per(masks) / bytes_of, per(same) / bytes_of, short / (words.count + 1.0)],
        axis=1,
    )
    return np.concatenate(rows), np.concatenate(found), patterns


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic texts, texts) of labelled texts, summed within a batch."""
    for batch in batches:
        y = batch.column(1).to_numpy().astype(np.int64)
        for first, data, offsets in T.chunks(batch.column(0)):
            row, token, _ = tokens(data, offsets)
            # each token once per row
            order = np.lexsort((row, token))
            row, token = row[order], token[order]
            keep = np.ones(len(row), bool)
            keep[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
            row, token = row[keep], token[keep]
            if not len(token):
                continue
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            bad = np.add.reduceat(y[first + row], start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[start].view(np.int64)), pa.array(bad), pa.array(np.diff(np.append(start, len(token))))],
                ["token", "bad", "n"],
            )


class Lexicon:
    """The tokens that voters look for, by hash."""

    def __init__(self, found: np.ndarray):
        self.order = np.argsort(found)
        self.known = found[self.order]
        self.bits = np.zeros(_BITS, bool)
        self.bits[(self.known & T.U64(_BITS - 1)).astype(np.int64)] = True

    def hits(self, row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, number of the token)."""
        at = np.flatnonzero(self.bits[(token & T.U64(_BITS - 1)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.known, token[at]), len(self.known) - 1)
        own = self.known[place] == token[at]
        pairs = np.unique(row[at[own]] * np.int64(len(self.known)) + self.order[place[own]])
        return pairs // len(self.known), pairs % len(self.known)


def _featured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, times = shared.value
        for batch in batches:
            drawn, place = batch.column(3).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(T.U64)
            for first, data, offsets in T.chunks(batch.column(0)):
                row, token, patterns = tokens(data, offsets)
                r, t = lexicon.hits(row, token)
                # times is 0 for tokens that the drawn rows have often enough
                rare = times[t] > 0
                chance = T.mix(place[first + r[rare]] + T.mix(t[rare].astype(T.U64))) % times[t[rare]]
                keep = drawn[first : first + len(patterns)].copy()
                keep[r[rare][chance < EACH]] = True
                cuts = np.searchsorted(r, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(first, len(patterns)),
                        batch.column(2).slice(first, len(patterns)),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(t, pa.int64())),
                        pa.array(list(patterns), pa.list_(pa.float64())),
                    ],
                    ["y", "place", "hits", "patterns"],
                ).filter(pa.array(keep))

    return run


def votes(hits: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstains; lexicons, patterns, then the voter for clean."""
    lexicons = np.stack([hits[:, j::LEXICONS].any(1) for j in range(LEXICONS)], axis=1).astype(np.int8)
    return np.concatenate(
        [lexicons, (patterns > np.array(THRESHOLDS)).astype(np.int8), -(~hits.any(1)).astype(np.int8)[:, None]], axis=1
    )


class LabelModel:
    """P(vote | class, vote of the parent) of each voter, for the tree of parents that the votes suggest.

    parent[j] is the voter on which j depends, or -1; table[y, j, s] is the share of vote s - 1 among the
    votes of j on class y, and pair[y, j, r, s] that among rows where the parent votes r - 1.
    """

    def __init__(self, v: np.ndarray, rate: float, rounds: int = 4, steps: int = 15):
        self.rate = float(np.clip(rate, 0.01, 0.99))
        n, k = v.shape
        self.votes = np.stack([v == s for s in (-1, 0, 1)], axis=2).astype(float)
        self.parent = np.full(k, -1)
        # at first voters are believed: a posterior from their sum
        q = 1 / (1 + np.exp(-2.0 * v.sum(1) - np.log(self.rate / (1 - self.rate)) * 0.5))
        for _ in range(rounds):
            for _ in range(steps):
                self._fit(q)
                q = self.posterior(v)
            parent = self._tree(q)
            if (parent == self.parent).all():
                break
            self.parent = parent
        self._fit(q)
        del self.votes

    def _fit(self, q: np.ndarray) -> None:
        """Smoothed tables from posteriors; a parent's rare votes borrow from all votes."""
        k = len(self.parent)
        flat = self.votes.reshape(len(q), -1)
        self.table, self.pair = np.zeros((2, k, 3)), np.zeros((2, k, 3, 3))
        for y, w in enumerate((1 - q, q)):
            c = (flat * w[:, None]).sum(0).reshape(k, 3) + 0.5
            self.table[y] = c / c.sum(1, keepdims=True)
            both = (flat.T @ (flat * w[:, None])).reshape(k, 3, k, 3)
            for j, i in enumerate(self.parent):
                c = (both[i, :, j] if i >= 0 else np.zeros((3, 3))) + 2 * self.table[y, j]
                self.pair[y, j] = c / c.sum(1, keepdims=True)

    def _tree(self, q: np.ndarray) -> np.ndarray:
        """Parents in the tree of greatest mutual information given the class."""
        n, k, _ = self.votes.shape
        flat, info = self.votes.reshape(n, -1), np.zeros((k, k))
        for w in (1 - q, q):
            joint = ((flat * w[:, None]).T @ flat).reshape(k, 3, k, 3).transpose(0, 2, 1, 3) / n
            share = max(w.sum() / n, 1e-12)
            single = np.einsum("jjss->js", joint)
            apart = single[:, None, :, None] * single[None, :, None, :] / share
            info += np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(apart, 1e-12)), 0).sum((2, 3))
        # twice n times the information is about chi square with 8 degrees of freedom where there is none: 26 is its 0.999 quantile
        info[2 * n * info < 26.1] = 0
        np.fill_diagonal(info, 0)
        parent, best, joined = np.full(k, -1), np.zeros(k), np.zeros(k, bool)
        for _ in range(k):
            j = int(np.argmax(np.where(joined, -1, best)))
            joined[j] = True
            if best[j] == 0:
                parent[j] = -1
            closer = ~joined & (info[j] > best)
            parent[closer], best[closer] = j, info[j][closer]
        return parent

    def posterior(self, v: np.ndarray) -> np.ndarray:
        at = v.astype(np.int64) + 1
        alone = np.log(self.table[1] / self.table[0])[np.arange(v.shape[1]), at]
        given = np.log(self.pair[1] / self.pair[0])[np.arange(v.shape[1]), at[:, self.parent], at]
        f = np.log(self.rate / (1 - self.rate)) + np.where(self.parent >= 0, given, alone).sum(1)
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


class Linear:
    """Logistic regression on posterior labels, by full gradients with momentum."""

    def __init__(self, x: np.ndarray, q: np.ndarray, ridge: float = 0.3, steps: int = 400):
        x = x.astype(np.float32, copy=False)
        n = len(x)
        w, move, b = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0
        # a few columns at once: the driver has little room
        squares = [(x[:, j : j + 32] ** 2).mean(0) for j in range(0, x.shape[1], 32)]
        size = np.maximum(np.concatenate(squares), 1.0 / n)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            g = (x.T @ (p - q) + ridge * w) / n
            move = 0.9 * move - 0.1 * g / (size + 0.02)
            w = w + move
            b -= 0.5 * float((p - q).mean())
        self.w, self.b = w.astype(np.float64), b


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w, b = shared.value
        k = len(lexicon.known)
        for batch in batches:
            for first, data, offsets in T.chunks(batch.column(0)):
                row, token, patterns = tokens(data, offsets)
                r, t = lexicon.hits(row, token)
                f = b + np.bincount(r, w[t], len(patterns)) + patterns @ w[k:]
                score = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(score)), pa.array(score)], ["key", "score"])

    return run


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    held_out: int = 0,
    threshold: float = 0.5,
    most: int = MOST,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """One row (key, held_out, score, predicted) per row of docs.

    Labels are 0 or 1; null ones, those of null keys and those of held-out keys are not learned, and a
    label that is given more than once counts once, the greatest. Only the text is scored; empty and
    null texts score as texts without tokens. Without labels of both kinds there are no lexicons, and
    the score is low everywhere. An empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(text).cast("string").alias("text"), F.col(key).alias("key"))
    taught = (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key, folds) != held_out))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    taught = checkpoint(taught)
    known = taught.count()
    drawn = checkpoint(bounded(taught, ["key"], most, known).select("key", F.lit(True).alias("drawn")))
    taught = checkpoint(taught.join(maybe_broadcast(drawn), "key", "left").withColumn("drawn", F.coalesce("drawn", F.lit(False))))
    labelled = source.filter(F.col("key").isNotNull() & (fold("key", folds) != held_out)).join(maybe_broadcast(taught, known), "key")
    bad, total = labelled.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (total - bad + 1.0))
    good, rate = F.col("n") - F.col("bad"), bad / max(total, 1)
    part = lambda x, of: F.when(x > 0, x * F.log(x / (F.col("n") * F.lit(float(of))))).otherwise(0.0)
    ratio = part(F.col("bad"), max(rate, 1e-12)) + part(good, max(1 - rate, 1e-12))
    chosen = (
        labelled.select("text", "y").mapInArrow(_counts, "token bigint, bad bigint, n bigint")
        .groupBy("token")
        .agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        .withColumn("odds", odds)
        .withColumn("ratio", ratio)
        .filter((F.col("odds") >= ODDS) & (F.col("ratio") >= EVIDENCE))
        .orderBy(F.desc(F.col("bad") * F.col("odds")), "token")
        .limit(TOKENS)
        .collect()
    )
    lexicon = Lexicon(np.array([r.token for r in chosen], np.int64).view(T.U64))
    k = len(chosen)
    w, b = np.zeros(k + len(PATTERNS)), -4.0
    if k:
        few = [r.n if r.n * most < EACH * known else 0 for r in chosen]
        shared = spark.sparkContext.broadcast((lexicon, np.array(few, T.U64)))
        rows = (
            labelled.select("text", "y", F.xxhash64("key", "text").alias("place"), "drawn")
            .mapInArrow(_featured(shared), "y int, place bigint, hits array<bigint>, patterns array<double>")
            .orderBy("place")
            .toPandas()
        )
        hits = np.zeros((len(rows), k), bool)
        for i, h in enumerate(rows["hits"]):
            hits[i, h] = True
        patterns = np.stack(rows["patterns"].to_list())
        model = LabelModel(v := votes(hits, patterns), float(rows["y"].mean()))
        fitted = Linear(np.concatenate([hits, patterns], axis=1, dtype=np.float32), model.posterior(v))
        w, b = fitted.w, fitted.b
        del rows, hits, patterns, v, model
        T.trim()
    kind = source.schema["key"].dataType.simpleString()
    scored = source.mapInArrow(_score(spark.sparkContext.broadcast((lexicon, w, b))), f"key {kind}, score double")
    return scored.select(
        F.col("key").alias(key), (fold("key", folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
