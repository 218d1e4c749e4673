"""Exact tests and seeded bootstraps. The draws are made in grouped Python over one row per cluster."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.session import Stages


def exact_mcnemar(n10: int, n01: int) -> float:
    """Two-sided binomial test of n10 against n01, by whole numbers up to 2,000 and by logarithms of factorials beyond."""
    n, k = n10 + n01, min(n10, n01)
    if n == 0 or 2 * k == n:
        return 1.0
    if n <= 2000:
        term, total = 1, 1
        for i in range(k):
            term = term * (n - i) // (i + 1)
            total += term
        return float(min(Fraction(1), Fraction(2 * total, 2**n)))
    top = math.lgamma(n + 1) - n * math.log(2)
    logs = [top - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k, -1, -1)]
    high, total = logs[0], 0.0
    for x in logs:
        if x < high - 60:
            break
        total += math.exp(x - high)
    return min(1.0, 2 * math.exp(high) * total)


@F.pandas_udf(T.DoubleType())
def _mcnemar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([exact_mcnemar(int(x), int(y)) for x, y in zip(a, b)])


def mcnemar(n10: Column, n01: Column) -> Column:
    return _mcnemar(n10, n01)


def percentile_interval(samples, confidence: float = 0.95) -> tuple[float, float]:
    """Central interval by linear interpolation; samples that aren't finite don't count."""
    s = np.asarray(samples, dtype=float)
    s = s[np.isfinite(s)]
    if not s.size:
        return math.nan, math.nan
    return tuple(float(x) for x in np.quantile(s, [(1 - confidence) / 2, (1 + confidence) / 2]))


def cluster_draws(sums: np.ndarray, counts: np.ndarray, replicates: int, seed: int, start: int = 0) -> np.ndarray:
    """Means of resampled clusters, clusters in the order given; replicates before `start` are drawn, but not evaluated."""
    rng = np.random.default_rng(seed)
    out = np.empty(replicates - start)
    for i in range(replicates):
        pick = rng.integers(0, counts.size, size=counts.size)
        if i >= start:
            out[i - start] = sums[pick].sum() / counts[pick].sum()
    return out


# the order of draws is fixed: a replicate after the other, dimensions in the order given, levels sorted
def multiplier_draws(codes: list[np.ndarray], levels: list[int], sums: np.ndarray, replicates: int, seed: int, counts: np.ndarray | None = None, start: int = 0) -> np.ndarray:
    """Weighted means under an exponential weight per level of every clustering. sums, counts: of the rows that share their levels (one row each by default)."""
    rng = np.random.default_rng(seed)
    counts = np.ones(sums.size) if counts is None else counts
    out = np.empty(replicates - start)
    for i in range(replicates):
        drawn = [rng.exponential(1.0, n) for n in levels]
        if i >= start:
            weight = np.ones(sums.size)
            for code, w in zip(codes, drawn):
                weight = weight * w[code]
            total = float(weight @ counts)
            out[i - start] = float(weight @ sums) / total if total else math.nan
    return out


#: replicates that one task evaluates; it draws those before them too, so that the draws are those of one run
REPLICATES = 250


def _schema(df: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema), rest])


def _spread(per: DataFrame, keys: list[str], replicates: int) -> DataFrame:
    """per (one row per cluster) once for every task that takes some of its key's replicates."""
    return per.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // REPLICATES))))


def _interval(samples: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    """(keys, low, high) of rows (keys, sample), by linear interpolation over the finite ones."""
    value = F.col("sample")
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return samples.groupBy(*keys).agg(*(F.coalesce(F.percentile(finite, F.lit(p)), F.lit(math.nan)).alias(n) for n, p in (("low", (1 - confidence) / 2), ("high", (1 + confidence) / 2))))


def bootstrap_means(rows: DataFrame, keys: list[str], cluster: str, value: str, replicates: int = 2000, seed: int = 45, confidence: float = 0.95) -> DataFrame:
    """(keys, mean, low, high, clusters): interval of the mean under resampling of whole clusters.

    Rows become one per cluster before any Python sees them. Null values and null clusters don't count;
    a key without rows has no interval.
    """
    per = rows.where(F.col(value).isNotNull() & F.col(cluster).isNotNull()).groupBy(*keys, cluster).agg(F.sum(value).cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    per = Stages(rows.sparkSession, "bootstrap").keep(per)
    point = per.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("clusters"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster)
        low = int(pdf["_chunk"].iloc[0]) * REPLICATES
        out = cluster_draws(pdf.s.to_numpy(), pdf.n.to_numpy(), min(replicates, low + REPLICATES), seed, low)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * out.size for k in keys}, "sample": out})

    samples = _spread(per, keys, replicates).groupBy(*keys, "_chunk").applyInPandas(run, _schema(per, keys, "sample double"))
    return _joined(point, _interval(samples, keys, confidence), keys).select(*keys, "mean", "low", "high", "clusters")


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' columns where their keys are the same, null being equal to null."""
    return a.join(b, [a[k].eqNullSafe(b[k]) for k in keys]).select(a["*"], *(b[c] for c in b.columns if c not in keys))


def multiway_bootstrap(rows: DataFrame, keys: list[str], clusters: list[str], value: str, replicates: int = 2000, seed: int = 45, confidence: float = 0.95) -> DataFrame:
    """(keys, mean, low, high, rows): interval of the mean under exponential weights for every level of every clustering.

    A row's weight is the product of the weights of its levels. Rows of equal levels become one before any
    Python sees them. Levels are ordered by their text; null values don't count, a null level is the text None.
    """
    if not clusters or len({*clusters}) != len(clusters):
        raise ValueError("clusters must be named, each once")
    names = [f"_l{i}" for i in range(len(clusters))]
    levels = [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(n) for c, n in zip(clusters, names)]
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, *levels).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").cast("double").alias("n"))
    per = Stages(rows.sparkSession, "bootstrap").keep(per)
    point = per.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").cast("long").alias("rows"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names)
        codes, sizes = zip(*((at, found.size) for found, at in (np.unique(pdf[n].to_numpy(dtype=str), return_inverse=True) for n in names)))
        low = int(pdf["_chunk"].iloc[0]) * REPLICATES
        out = multiplier_draws(list(codes), list(sizes), pdf.s.to_numpy(), min(replicates, low + REPLICATES), seed, pdf.n.to_numpy(), low)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * out.size for k in keys}, "sample": out})

    samples = _spread(per, keys, replicates).groupBy(*keys, "_chunk").applyInPandas(run, _schema(per, keys, "sample double"))
    return _joined(point, _interval(samples, keys, confidence), keys).select(*keys, "mean", "low", "high", "rows")


BATCH = 100


def paired_draws(cells: np.ndarray, valid: np.ndarray, correct: np.ndarray, base: int, replicates: int, seed: int, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(replicate, series): F1 and recall of every series less those of `base`, clusters being drawn by multinomials in batches of 100."""
    rng, n = np.random.default_rng(seed), cells.size
    out = [], []
    for low in range(0, replicates, BATCH):
        weights = rng.multinomial(n, np.full(n, 1.0 / n), size=min(BATCH, replicates - low))
        if low + BATCH <= start:
            continue
        all_, ok, right = weights @ cells, weights @ valid, weights @ correct
        with np.errstate(invalid="ignore", divide="ignore"):
            precision, recall = np.nan_to_num(right / ok), np.nan_to_num(right / all_[:, None])
            f1 = np.nan_to_num(2 * precision * recall / (precision + recall))
        keep = np.arange(low, low + len(weights)) >= start
        for store, x in zip(out, (f1, recall)):
            store.append((x - x[:, [base]])[keep])
    return np.concatenate(out[0]), np.concatenate(out[1])


def paired_bootstrap(matrix: DataFrame, keys: list[str], cluster: str, series: str, base: str, replicates: int = 2000, seed: int = 45, confidence: float = 0.95) -> DataFrame:
    """(keys, series, f1_delta, recall_delta with low and high, p): every series against `base` under resampling of whole clusters.

    matrix: (keys, cluster, series, cells, valid, correct), a row for each series of a cluster; cells is the
    same for all series of a cluster, and a series that a cluster lacks has none right there. p is two-sided.
    Keys without the base have no rows. The seed of a key is derived from its names.
    """
    per = Stages(matrix.sparkSession, "bootstrap").keep(matrix.select(*keys, cluster, series, "cells", "valid", "correct"))
    rest = f"{series} string, f1_sample double, recall_sample double, f1_delta double, recall_delta double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf[series].unique())
        if base not in names or len(names) < 2:
            none = pdf[[*keys, series]].head(0)
            return none.assign(**{c: pd.Series(dtype=float) for c in ("f1_sample", "recall_sample", "f1_delta", "recall_delta")})
        wide = {c: pdf.pivot(index=cluster, columns=series, values=c).sort_index()[names] for c in ("cells", "valid", "correct")}
        cells = wide["cells"].max(axis=1).to_numpy(dtype=float)
        valid, correct = (wide[c].fillna(0).to_numpy(dtype=float) for c in ("valid", "correct"))
        low, own = int(pdf["_chunk"].iloc[0]) * REPLICATES, derived_seed(seed, *(pdf[k].iloc[0] for k in keys), modulus=1 << 64)
        f1, recall = paired_draws(cells, valid, correct, names.index(base), min(replicates, low + REPLICATES), own, low)
        ok, right, whole = valid.sum(axis=0), correct.sum(axis=0), cells.sum()
        p, r = np.divide(right, ok, out=np.zeros_like(right), where=ok > 0), right / whole
        f = np.divide(2 * p * r, p + r, out=np.zeros_like(p), where=p + r > 0)
        at = names.index(base)
        other = [i for i in range(len(names)) if i != at]
        each = len(f1)
        return pd.DataFrame({
            **{k: [pdf[k].iloc[0]] * (each * len(other)) for k in keys}, series: [names[i] for i in other for _ in range(each)], "f1_sample": f1[:, other].T.ravel(), "recall_sample": recall[:, other].T.ravel(),
            "f1_delta": np.repeat(f[other] - f[at], each), "recall_delta": np.repeat(r[other] - r[at], each),
        })

    samples = _spread(per, keys, replicates).groupBy(*keys, "_chunk").applyInPandas(run, _schema(per, keys, rest))
    x, n = F.col("f1_sample"), F.count("*")
    tail = lambda c: (F.sum(c.cast("int")) + 1) / (n + 1)
    cut = lambda c, p: F.percentile(c, F.lit(p))
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    return samples.groupBy(*keys, series).agg(
        F.first("f1_delta").alias("f1_delta"), cut("f1_sample", low).alias("f1_low"), cut("f1_sample", high).alias("f1_high"),
        F.first("recall_delta").alias("recall_delta"), cut("recall_sample", low).alias("recall_low"), cut("recall_sample", high).alias("recall_high"),
        F.least(F.lit(1.0), 2 * F.least(tail(x <= 0), tail(x >= 0))).alias("p"),
    )


def derived_seed(*parts: object, modulus: int = 2**32) -> int:
    import hashlib

    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16], 16) % modulus


