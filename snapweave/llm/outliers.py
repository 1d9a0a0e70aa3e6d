"""Quality rules by robust multivariate outliers.

Each document is a vector of transformed statistics. For each language and source the minimum
covariance determinant estimate gives a centre and a scatter: from medians and quartile ranges,
concentration steps keep the share ALPHA of documents with the least Mahalanobis distance and take
their mean and covariance, until STEPS are done; each step can only lower the determinant. Documents
whose distance is beyond a high quantile of chi square are rejected.

All documents count, and no group is gathered: quantiles come from histograms on fixed grids (of the
statistics, and of the logarithm of the distance), means and covariances from sums, all aggregated
before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapweave.llm import _stats
from snapweave.llm._tables import checkpoint, maybe_broadcast

#: Share of a group that a concentration step keeps, and the number of steps.
ALPHA, STEPS = 0.75, 4
#: A group needs so many documents of its own; smaller ones take the estimate of their language, or of all.
LEAST = 60
#: Chance that a normal document is beyond the cut.
BEYOND = 1e-3
#: Least standard deviation of each transformed statistic, below the estimates of the continuous ones. Repeats
#: are 0 in most documents, so the estimate of what is kept says nothing about ordinary repeats: theirs are wide.
FLOORS = (0.01, 0.03, 0.15, 0.12, 0.005, 0.005)
P = len(FLOORS)
_GRID, _FINE = 256, 32


def _transformed() -> list[F.Column]:
    c = lambda n: F.col(n).cast("double")
    words, chars = c("n_words") + 1, c("word_chars") + 1
    return [
        F.log(chars / words),
        F.sqrt(c("n_symbols") / chars),
        F.sqrt(c("n_dup_lines") / (c("n_lines") + 1)),
        F.sqrt(c("n_repeat_words") / words),
        F.sqrt(c("n_upper") / chars),
        F.sqrt(c("n_punct") / chars),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """Chi square distribution with an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _cells() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i, P)]


def _solve(consistency: float):
    """Means and covariances from sums, floored, and the inverse: one row a group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                n, sums, cross = r.n, np.array(r.sums), np.zeros((P, P))
                for (i, j), v in zip(_cells(), r.cross, strict=True):
                    cross[i, j] = cross[j, i] = v
                mean = sums / n
                cov = (cross / n - np.outer(mean, mean)) * consistency
                lack = np.maximum(np.array(FLOORS) ** 2 - np.diag(cov), 0)
                out.append((r.g, mean.tolist(), np.linalg.inv(cov + np.diag(lack)).ravel().tolist()))
            yield pd.DataFrame(out, columns=["g", "m", "w"])

    return run


def _distance() -> F.Column:
    d = [f"(z{i} - m[{i}])" for i in range(P)]
    return F.expr(" + ".join(f"{1 if i == j else 2} * {d[i]} * {d[j]} * w[{i * P + j}]" for i, j in _cells()))


def _estimates(fit: DataFrame) -> DataFrame:
    """(g, m, w): centre and inverse scatter of each group of fit (g, z0, z1, ...)."""
    # medians and quartile ranges on a grid of 1/256
    long = fit.select("g", F.posexplode(F.array(*[F.round(F.col(f"z{i}") * _GRID).cast("int") for i in range(P)])).alias("j", "bin"))
    bins = long.groupBy("g", "j", "bin").agg(F.count("*").alias("n"))
    run = Window.partitionBy("g", "j")
    upto = F.sum("n").over(run.orderBy("bin"))
    bins = bins.withColumn("part", upto / F.sum("n").over(run))
    at = lambda q: F.min(F.when(F.col("part") >= q, F.col("bin"))) / _GRID
    start = bins.groupBy("g", "j").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("sd"))
    floors = F.array(*map(F.lit, FLOORS))
    start = (
        start.withColumn("sd", F.greatest("sd", F.get(floors, F.col("j"))))
        .groupBy("g")
        .agg(F.array_sort(F.collect_list(F.struct("j", "mid", "sd"))).alias("all"))
    )
    weights = [F.when(F.lit(i == j), F.pow(F.col("all.sd")[i], F.lit(-2))).otherwise(F.lit(0.0)) for i in range(P) for j in range(P)]
    now = checkpoint(start.select("g", F.col("all.mid").alias("m"), F.array(*weights).alias("w")))
    groups = now.count()
    # a normal group's kept share has a smaller covariance than the whole
    consistency = ALPHA / chi2_cdf(chi2_quantile(ALPHA, P), P + 2)
    for _ in range(STEPS):
        near = fit.join(maybe_broadcast(now, groups), "g").withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * _FINE))
        counts = near.groupBy("g", "bin").agg(F.count("*").alias("n"))
        run = Window.partitionBy("g")
        kept = counts.withColumn("part", F.sum("n").over(run.orderBy("bin")) / F.sum("n").over(run))
        kept = kept.filter(F.col("part") >= ALPHA).groupBy("g").agg(F.min("bin").alias("most"))
        kept = maybe_broadcast(kept, groups)
        sums = (
            near.join(kept, "g")
            .filter("bin <= most")
            .groupBy("g")
            .agg(
                F.count("*").alias("n"),
                F.array(*[F.sum(f"z{i}") for i in range(P)]).alias("sums"),
                F.array(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in _cells()]).alias("cross"),
            )
        )
        now = checkpoint(sums.mapInPandas(_solve(consistency), "g string, m array<double>, w array<double>"))
    return now


def judged(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """One row per row of docs: key, counts, base_failed, distance and kept.

    base_failed: fewer than 50 words, or more than half of them in runs of three words that the text
    has twice or more. kept is false if base_failed, or if the squared distance is beyond the cut.
    Estimates are fitted to the documents that aren't base_failed. Null languages and sources are
    groups of their own; groups of fewer than LEAST documents take the estimate of all documents of
    their language, and where that has fewer too, of all documents. Only if all are fewer than LEAST, the
    distance is null and the base rules decide. Empty and null texts are
    base_failed; an empty table gives an empty table; other columns are not read.
    """
    rows = _stats.counted(docs, text, key=key, lang=lang, source=source).select(
        "key",
        *_stats.COUNTS[:5],
        F.to_json(F.struct("lang", "source")).alias("fine"),
        F.to_json(F.struct("lang")).alias("wide"),
        F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
        *[c.alias(f"z{i}") for i, c in enumerate(_transformed())],
    )
    rows = checkpoint(rows)
    fit = rows.filter("not base_failed")
    every = F.lit("")
    sizes = checkpoint(fit.groupBy("fine", "wide").agg(F.count("*").alias("n")))
    # what each small group falls back to, and for each group the estimates that it is fitted to
    wide = sizes.groupBy("wide").agg(F.sum("n").alias("n_wide"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    level = (
        F.when(F.col("n") >= LEAST, F.col("fine")).when(F.col("n_wide") >= LEAST, F.col("wide")).when(F.lit(total >= LEAST), every)
    )
    own = checkpoint(sizes.join(wide, "wide").select("fine", "wide", level.alias("g")))
    used = own.select("g").distinct()
    fitted = own.select("fine", F.explode(F.array("fine", "wide", every)).alias("g")).join(used, "g", "left_semi")
    names = [f"z{i}" for i in range(P)]
    fitted = checkpoint(fitted)
    estimates = _estimates(fit.join(maybe_broadcast(fitted), "fine").select("g", *names))
    rows = rows.join(maybe_broadcast(own.select("fine", "g")), "fine", "left")
    cut = chi2_quantile(1 - BEYOND, P)
    return (
        rows.join(maybe_broadcast(estimates), "g", "left")
        .withColumn("distance", F.when(~F.col("base_failed"), _distance()))
        .select(
            F.col("key").alias(key), *_stats.COUNTS[:5], "base_failed",
            (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"), "distance",
        )
    )
