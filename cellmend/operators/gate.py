"""A gate that predicts whether asking helps or harms, with spread from leaving out one family at a time."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.operators.cells import ORACLE_FIELDS
from cellmend.session import Stages

# fixed values: presets named after common boosters
PRESETS = {"boost_a": dict(maxIter=20, maxDepth=5, maxBins=64), "boost_b": dict(maxIter=20, maxDepth=6, maxBins=64), "tree_b": dict(maxIter=10, maxDepth=4)}
# fixed values: columns that tell the right value or the label
FORBIDDEN = {"annotation", "baran_correct", "clean_value", "correct_repair", "error_type", "harmful", "helpful", "llm_correct", "llm_correct_in_query", "missing_value", "right_value", "tuple_pairs"} | {*ORACLE_FIELDS, "base_correct"}


def uplift_targets(df: DataFrame, base: str, llm: str, executable: str) -> DataFrame:
    """helpful: the answer would be used, is right, and the base is wrong; harmful: the other way round."""
    b, l, x = (F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in (base, llm, executable))
    return df.withColumns({"helpful": (x & l & ~b).cast("int"), "harmful": (x & b & ~l).cast("int")})


def training_rows(df: DataFrame, family: str, target: str, suite: str | None = None, allowed: str | None = None) -> DataFrame:
    """Rows of other families than the target's, of one suite if wanted."""
    rows = df.where(~F.col(family).eqNullSafe(F.lit(target)))
    return rows.where(F.col(suite) == allowed) if suite else rows


def gain_and_spread(predictions: DataFrame, keys: list[str], harm_weight: float = 1.0, spread_weight: float = 1.0) -> DataFrame:
    """net = helpful - weight * harmful of the full model; sigma over the replicas (0 for fewer than two); l = max(0, net - weight * sigma)."""
    net = F.col("p_helpful") - harm_weight * F.col("p_harmful")
    full = F.col("replica") == "full"
    out = predictions.groupBy(*keys).agg(F.max(F.when(full, net)).alias("net_gain"), F.coalesce(F.stddev_samp(F.when(~full, net)), F.lit(0.0)).alias("sigma"))
    return out.withColumn("conservative_uplift", F.greatest(F.lit(0.0), F.col("net_gain") - spread_weight * F.col("sigma")))


class UpliftGate:
    """Two binary heads on the same features, each fitted on all families and once without each.

    numeric features are filled with the training median, categories are indexed by their frequency in
    training with unseen ones kept apart. A head whose labels are all alike predicts that label. Rows
    without a family are in the training of every replica. Linear heads of all replicas are fitted
    together, one pass over the rows a step; boosted ones one after the other.
    """

    def __init__(self, numeric: list[str], categorical: list[str], family: str, preset: str = "boost_a", linear: bool = False, seed: int = 45):
        told = sorted(c for c in (*numeric, *categorical) if str(c).strip().lower() in FORBIDDEN)
        if told:
            raise ValueError(f"features that tell the right value: {told}")
        self.numeric, self.categorical, self.family, self.preset, self.linear, self.seed = numeric, categorical, family, preset, linear, seed

    def _features(self, train: DataFrame):
        steps = [Imputer(strategy="median", inputCols=self.numeric, outputCols=[f"_i_{c}" for c in self.numeric])] if self.numeric else []
        if self.categorical:
            steps.append(StringIndexer(inputCols=self.categorical, outputCols=[f"_c_{c}" for c in self.categorical], handleInvalid="keep"))
        steps.append(VectorAssembler(inputCols=[*(f"_i_{c}" for c in self.numeric), *(f"_c_{c}" for c in self.categorical)], outputCol="_x"))
        return Pipeline(stages=steps).fit(train)

    def _head(self, train: DataFrame, test: DataFrame, label: str, out: str) -> DataFrame:
        low, high = train.agg(F.min(label), F.max(label)).first()
        if low is None or low == high:
            return test.withColumn(out, F.lit(float(low or 0)))
        model = GBTClassifier(featuresCol="_x", labelCol="_y", seed=self.seed, **PRESETS[self.preset])
        scored = model.fit(train.select("_x", F.col(label).cast("double").alias("_y"))).transform(test)
        return scored.withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """test with replica, p_helpful and p_harmful, one row per replica."""
        train, test = (df.withColumns({**{c: F.col(c).cast("double") for c in self.numeric}, **{c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.categorical}}) for df in (train, test))
        families = sorted(r[0] for r in train.where(F.col(self.family).isNotNull()).select(self.family).distinct().collect())
        if self.linear:
            return self._linear(train, test, families)
        parts = []
        for name, rows in [("full", train), *((f, training_rows(train, self.family, f)) for f in families)]:
            if rows.isEmpty():
                continue
            features = self._features(rows)
            own, x = features.transform(rows).select("_x", "helpful", "harmful").persist(), features.transform(test)
            x = self._head(own, self._head(own, x, "helpful", "p_helpful"), "harmful", "p_harmful")
            parts.append(x.select(*test.columns, "p_helpful", "p_harmful").withColumn("replica", F.lit(name)))
            own.unpersist()
        return reduce(DataFrame.unionByName, parts)

    def _linear(self, train: DataFrame, test: DataFrame, families: list[str]) -> DataFrame:
        wide = 2 * train.sparkSession.sparkContext.defaultParallelism
        rows = Stages(train.sparkSession, "gate").keep(train.select(F.col(self.family).alias("_f"), *self.numeric, *self.categorical, "helpful", "harmful").repartition(wide))
        heads = LinearHeads(families, self.numeric, self.categorical).fit(rows)
        score = F.pandas_udf(heads.score, "helpful array<double>, harmful array<double>")
        names = F.split(F.lit("\x1f".join(heads.names)), "\x1f")
        scored = test.withColumn("_s", score(*self.numeric, *self.categorical))
        return scored.select(*test.columns, F.inline(F.arrays_zip(names, F.col("_s.helpful"), F.col("_s.harmful"))).alias("replica", "p_helpful", "p_harmful")).select(*test.columns, "p_helpful", "p_harmful", "replica")


#: parts of a column's values that its medians are told apart by, finer than Imputer's 0.001
CUTS = 2048
STEPS, NEAR = 50, 1e-8
PENALTY = 0.01


class LinearHeads:
    """Both logistic heads of every replica, fitted by Newton's method with the ridge penalty on standardised features.

    Replica 0 has all rows, replica i those not of family i. What is held is per replica and category or
    feature; every step is one pass over the rows whose sums are added up by Spark.
    """

    def __init__(self, families: list[str], numeric: list[str], categorical: list[str]):
        self.numeric, self.categorical, self.p = numeric, categorical, len(numeric) + len(categorical)
        self.place = {f: i + 1 for i, f in enumerate(families)}
        self.names = ["full", *families]

    def _without(self, counts: list, size: int) -> np.ndarray:
        """(replica, slot): sums of counts (family, slot, n) without the replica's family."""
        out = np.zeros((len(self.names), size))
        for f, slot, n in counts:
            out[:, slot] += n
            if f is not None:
                out[self.place[f], slot] -= n
        return out

    def _encode(self, rows: DataFrame) -> None:
        self.slots, self.codes = [], []
        for c in self.categorical:
            counts = rows.groupBy("_f", c).count().collect()
            at = {v: i for i, v in enumerate(sorted({r[c] for r in counts}))}
            n = self._without([(r["_f"], at[r[c]], r["count"]) for r in counts], len(at))
            order = np.argsort(-n, axis=1, kind="stable")  # of equals the smaller name first
            codes = np.empty((len(n), len(at) + 1))
            np.put_along_axis(codes, order, np.broadcast_to(np.arange(len(at), dtype=float), n.shape), axis=1)
            seen = (n > 0).sum(axis=1)
            codes[:, -1] = seen
            codes[:, :-1] = np.where(n > 0, codes[:, :-1], seen[:, None])
            self.slots.append(at)
            self.codes.append(codes)
        self.medians = np.zeros((len(self.names), len(self.numeric)))
        for j, c in enumerate(self.numeric):
            known = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
            cuts = sorted(set(known.approxQuantile(c, [i / CUTS for i in range(CUTS + 1)], 0.25 / CUTS)))
            if not cuts:
                raise ValueError(f"{c} has no value")
            bins = F.pandas_udf(lambda v, cuts=cuts: pd.Series(np.minimum(np.searchsorted(cuts, v), len(cuts) - 1)), "long")
            counts = known.select("_f", bins(c).alias("b")).groupBy("_f", "b").count().collect()
            below = self._without([tuple(r) for r in counts], len(cuts)).cumsum(axis=1)
            self.medians[:, j] = np.array(cuts)[np.argmax(below >= np.ceil(below[:, -1:] / 2), axis=1)]

    def _raw(self, pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        number = pdf[self.numeric].to_numpy(dtype=float) if self.numeric else np.zeros((len(pdf), 0))
        return number, [pdf[c].map(at).fillna(len(at)).to_numpy(dtype=int) for c, at in zip(self.categorical, self.slots)]

    def _x(self, r: int, number: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.where(np.isnan(number), self.medians[r], number), *(codes[r][s] for codes, s in zip(self.codes, slots))])

    def _z(self, r: int, number: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.ones(len(number)), (self._x(r, number, slots) - self.mean[r]) * self.scale[r]])

    def _sums(self, rows: DataFrame, of) -> np.ndarray:
        """The sums over all rows of what `of` (replica, number, slots, labels) gives per replica."""

        def run(batches):
            total = None
            for pdf in batches:
                number, slots = self._raw(pdf)
                family = pdf["_f"].map(self.place).fillna(0).to_numpy(dtype=int)
                y = pdf[["helpful", "harmful"]].to_numpy(dtype=float)
                part = []
                for r in range(len(self.names)):
                    k = (family != r) | (r == 0)
                    part.append(of(r, number[k], [s[k] for s in slots], y[k]))
                total = np.array(part) if total is None else total + np.array(part)
            if total is not None:
                yield pd.DataFrame({"r": range(len(total)), "v": list(total)})

        per = rows.mapInPandas(run, "r int, v array<double>").select("r", F.posexplode("v").alias("i", "v")).groupBy("r", "i").agg(F.sum("v").alias("v"))
        got = per.toPandas()
        out = np.zeros((len(self.names), int(got.i.max()) + 1))
        out[got.r, got.i] = got.v
        return out

    def fit(self, rows: DataFrame) -> LinearHeads:
        self._encode(rows)
        p = self.p

        def moments(r, number, slots, y):
            x = self._x(r, number, slots)
            return np.concatenate([[len(y)], y.sum(axis=0), x.sum(axis=0), (x**2).sum(axis=0)])

        m = self._sums(rows, moments)
        there = np.flatnonzero(m[:, 0] > 0)  # a family that has all rows can't be left out
        m, self.medians, self.codes = m[there], self.medians[there], [c[there] for c in self.codes]
        self.names = [self.names[i] for i in there]
        renumbered = {int(i): k for k, i in enumerate(there)}
        self.place = {f: renumbered.get(i, 0) for f, i in self.place.items()}
        n = m[:, :1]
        self.mean = m[:, 3 : 3 + p] / n
        spread = np.sqrt(np.maximum(0, m[:, 3 + p :] - n * self.mean**2) / np.maximum(1, n - 1))
        flat = spread <= 1e-9 * np.maximum(1, np.abs(self.mean))
        self.scale = np.where(flat, 0, 1 / np.where(flat, 1, spread))
        share = m[:, 1:3] / n
        self.constant = np.where((share == 0) | (share == 1), share, np.nan)
        clipped = np.clip(share, 1e-12, 1 - 1e-12)
        good = np.zeros((len(n), 2, p + 1))
        good[:, :, 0] = np.log(clipped / (1 - clipped))
        self.weights, step, direction, best = good.copy(), np.ones((len(n), 2)), np.zeros_like(good), np.full((len(n), 2), np.inf)
        upper = np.triu_indices(p + 1)
        ridge = PENALTY * np.diag([0.0, *([1.0] * p)])

        def slopes(r, number, slots, y):
            z, out = self._z(r, number, slots), []
            for h in (0, 1):
                t = z @ self.weights[r, h]
                q = 1 / (1 + np.exp(-np.clip(t, -500, 500)))
                second = z.T @ (z * (q * (1 - q))[:, None])
                out += [[(np.logaddexp(0, t) - y[:, h] * t).sum()], z.T @ (q - y[:, h]), second[upper]]
            return np.concatenate(out)

        for _ in range(STEPS):
            s = self._sums(rows, slopes).reshape(len(n), 2, -1) / n[:, :, None]
            w = self.weights
            loss = s[:, :, 0] + PENALTY / 2 * (w[:, :, 1:] ** 2).sum(axis=2)
            better = loss <= best + 1e-13
            second = np.zeros((len(n), 2, p + 1, p + 1))
            second[:, :, upper[0], upper[1]] = second[:, :, upper[1], upper[0]] = s[:, :, p + 2 :]
            slope = s[:, :, 1 : p + 2] + w @ ridge
            newton = -np.linalg.solve(second + ridge + 1e-12 * np.eye(p + 1), slope[..., None])[..., 0]
            good, best = np.where(better[..., None], w, good), np.where(better, loss, best)
            direction = np.where(better[..., None], newton, direction)
            step = np.where(better, 1.0, step / 2)
            moved = step[..., None] * direction
            moved[~np.isnan(self.constant)] = 0
            self.weights = good + moved
            if np.abs(moved).max() < NEAR:
                break
        return self

    def score(self, *columns: pd.Series) -> pd.DataFrame:
        number, slots = self._raw(pd.DataFrame(dict(zip([*self.numeric, *self.categorical], columns))))
        out = np.empty((2, len(number), len(self.names)))
        for r in range(len(self.names)):
            q = 1 / (1 + np.exp(-np.clip(self._z(r, number, slots) @ self.weights[r].T, -500, 500)))
            out[:, :, r] = np.where(np.isnan(self.constant[r]), q, self.constant[r]).T
        return pd.DataFrame({"helpful": list(out[0]), "harmful": list(out[1])})
