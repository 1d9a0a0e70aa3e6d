"""Quality classifier: generalised additive model with pairwise interactions.

Each feature is cut into bins. Boosting cycles through the features: a tree of at most LEAVES leaves
on one feature's bins is fitted to the gradient, shrunk, and added to that feature's lookup table. When
the single features are done, the pairs whose coarse grid explains most of what is left are boosted
in the same way. A score is the sum of one table entry per feature and pair, so scoring a batch is a
few vectorised additions.

The model is fitted on the driver to the feature vectors of at most `most` labelled documents, the
least by a seeded hash; the features themselves are computed by the executors over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.llm import _stats
from snapweave.llm._tables import bounded, checkpoint, fold, maybe_broadcast

BINS, COARSE, LEAVES, PAIRS = 48, 8, 4, 8
RATE, ROUNDS, PAIR_ROUNDS, RIDGE, LEAST = 0.15, 120, 60, 5.0, 5
#: Labelled documents that the fit takes at most.
MOST = 20_000


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Newton steps of a greedy tree over ordered bins."""
    cg, ch, cn = (np.concatenate([[0], np.cumsum(x)]) for x in (g, h, n))
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p, (a, b) in enumerate(parts):
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            gain = worth(a, at) + worth(at, b) - worth(a, b)
            gain[(cn[at] - cn[a] < LEAST) | (cn[b] - cn[at] < LEAST)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], p, int(at[k]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


class Additive:
    """Lookup tables of single features and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, p = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(p)]
        self.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, COARSE + 1)[1:-1])) for j in range(p)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        bins = self._bins(x, self.edges)
        f = np.full(n, self.base)
        for _ in range(ROUNDS):
            for j in range(p):
                self._boost(self.tables[j], bins[:, j], f, y)
        grid = self._bins(x, self.coarse)
        prob = 1 / (1 + np.exp(-f))
        g, h = prob - y, prob * (1 - prob)
        gains = []
        for i in range(p):
            for j in range(i):
                cell = grid[:, i] * COARSE + grid[:, j]
                sums = [np.bincount(cell, w, COARSE * COARSE).reshape(COARSE, COARSE) for w in (g, h)]
                one = lambda a, b: (a**2 / (b + RIDGE)).sum()
                gains.append((one(*sums) - max(one(*(s.sum(k) for s in sums)) for k in (0, 1)), i, j))
        self.pairs = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                prob = 1 / (1 + np.exp(-f))
                cell = grid[:, i] * COARSE + grid[:, j]
                g, h, m = (np.bincount(cell, w, COARSE * COARSE).reshape(COARSE, COARSE) for w in (prob - y, prob * (1 - prob), np.ones(n)))
                # one cut of the first feature, then a cut of the second on either side
                cut = self._cut(g.sum(1), h.sum(1))
                step = np.zeros((COARSE, COARSE))
                for side in (slice(0, cut), slice(cut, COARSE)):
                    step[side] = _tree(g[side].sum(0), h[side].sum(0), m[side].sum(0), 2)
                table += RATE * step
                f += RATE * step[grid[:, i], grid[:, j]]

    @staticmethod
    def _cut(g: np.ndarray, h: np.ndarray) -> int:
        cg, ch = np.cumsum(g), np.cumsum(h)
        gain = cg[:-1] ** 2 / (ch[:-1] + RIDGE) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + RIDGE)
        return int(gain.argmax()) + 1

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], axis=1)

    @staticmethod
    def _boost(table: np.ndarray, at: np.ndarray, f: np.ndarray, y: np.ndarray) -> None:
        prob = 1 / (1 + np.exp(-f))
        size = len(table)
        g, h, n = (np.bincount(at, w, size) for w in (prob - y, prob * (1 - prob), None))
        step = RATE * _tree(g, h, n)
        table += step
        f += step[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        bins, grid = self._bins(x, self.edges), self._bins(x, self.coarse)
        for j, table in enumerate(self.tables):
            f += table[bins[:, j]]
        for i, j, table in self.pairs:
            f += table[grid[:, i], grid[:, j]]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy() for i in range(len(_stats.COUNTS))], axis=1)
            score = model.score(_stats.features(x)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(len(_stats.COUNTS)), pa.array(score)], ["key", "score"])

    return run


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 4,
    held_out: int = 2,
    threshold: float = 0.7,
    most: int = MOST,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """One row (key, held_out, score, predicted) per row of docs.

    Labels are 0 or 1; null ones, those of null keys and those of held-out keys are not learned, and a
    label that is given more than once counts once, the greatest. Only the text is scored: an empty or
    null text scores as one of no words. Without any label to learn, or with one kind only, the score
    is the rate of the labels, or 0.5. An empty table gives an empty table; other columns are not read.
    """
    rows = checkpoint(_stats.counted(docs, text, key=key))
    taught = (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key, folds) != held_out))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(label).alias("y"))
    )
    taught = checkpoint(taught)
    taught = checkpoint(bounded(taught, ["key"], most, taught.count()))
    sample = rows.join(maybe_broadcast(taught), "key").select("key", "y", *_stats.COUNTS).orderBy("key", *_stats.COUNTS).limit(2 * most).toPandas()
    model = docs.sparkSession.sparkContext.broadcast(fit(sample[list(_stats.COUNTS)].to_numpy(np.int64), sample["y"].to_numpy(np.float64)))
    kind = rows.schema["key"].dataType.simpleString()
    scored = rows.select(*_stats.COUNTS, "key").mapInArrow(_score(model), f"key {kind}, score double")
    return scored.select(
        F.col("key").alias(key), (fold("key", folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


class Rate:
    """What is known without two kinds of labels."""

    def __init__(self, rate: float):
        self.rate = rate

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.rate)


def fit(counts: np.ndarray, y: np.ndarray):
    if len(set(y.tolist())) < 2:
        return Rate(float(y.mean()) if len(y) else 0.5)
    return Additive(_stats.features(counts), y)
