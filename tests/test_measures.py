"""Bootstraps against plain loops with the same draws, and states of answers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmend.operators import groups, statistics


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    return [("k" if i % 3 else None, f"r{rng.integers(9)}", None if i % 17 == 0 else f"c{rng.integers(4)}", float(rng.normal())) for i in range(n)]


def test_multiway_bootstrap_against_plain_loops(spark):
    rows = [*_rows(120, 1), ("k", "r1", "c1", None)]
    df = spark.createDataFrame(rows, "k string, a string, b string, v double")
    got = {r.k: (r["mean"], r.low, r.high, r["rows"]) for r in statistics.multiway_bootstrap(df, ["k"], ["a", "b"], "v", 600, 45).collect()}
    for k in ("k", None):
        own = [(a, str(b), v) for kk, a, b, v in rows if kk == k and v is not None]
        levels = [sorted({r[i] for r in own}) for i in (0, 1)]
        rng, samples = np.random.default_rng(45), []
        for _ in range(600):
            w = [dict(zip(lv, rng.exponential(1.0, len(lv)))) for lv in levels]
            weights = [w[0][a] * w[1][b] for a, b, _ in own]
            samples.append(sum(x * v for x, (_, _, v) in zip(weights, own)) / sum(weights))
        low, high = np.quantile(samples, [0.025, 0.975])
        assert got[k] == (pytest.approx(np.mean([v for _, _, v in own])), pytest.approx(low), pytest.approx(high), len(own))
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            statistics.multiway_bootstrap(df, ["k"], wrong, "v")
    assert statistics.multiway_bootstrap(df.where("false"), ["k"], ["a"], "v").collect() == []


def test_interval_leaves_out_what_is_not_finite():
    assert statistics.percentile_interval([1, 2, math.inf, -math.inf, math.nan]) == (1.025, 1.975)
    assert all(math.isnan(x) for x in statistics.percentile_interval([math.inf]))


def test_paired_bootstrap_against_plain_loops(spark):
    rng = np.random.default_rng(5)
    names = ["a", "base", "z"]
    cells = rng.integers(1, 6, 30)
    valid = np.minimum(cells[:, None], rng.integers(0, 7, (30, 3)))
    correct = np.minimum(valid, rng.integers(0, 7, (30, 3)))
    rows = [("s", f"c{i:02d}", n, int(cells[i]), int(valid[i, j]), int(correct[i, j])) for i in range(30) for j, n in enumerate(names)] + [("t", "c", "a", 1, 1, 1)]
    df = spark.createDataFrame(rows, "s string, cluster string, series string, cells int, valid int, correct int")
    got = {r.series: r for r in statistics.paired_bootstrap(df, ["s"], "cluster", "series", "base", 450, 45).collect()}
    assert set(got) == {"a", "z"}
    seed = int(hashlib.sha256(b"45|s").hexdigest()[:16], 16)
    draws, samples = np.random.default_rng(seed), []
    for size in (100, 100, 100, 100, 50):
        for w in draws.multinomial(30, np.full(30, 1 / 30), size=size):
            f1 = []
            for j in range(3):
                v, c = w @ valid[:, j], w @ correct[:, j]
                p, r = (c / v if v else 0), c / (w @ cells)
                f1.append(2 * p * r / (p + r) if p + r else 0)
            samples.append(f1)
    samples = np.array(samples)
    for j, n in ((0, "a"), (2, "z")):
        delta = samples[:, j] - samples[:, 1]
        assert (got[n].f1_low, got[n].f1_high) == tuple(map(pytest.approx, np.quantile(delta, [0.025, 0.975])))
        assert got[n].p == pytest.approx(min(1, 2 * min((delta <= 0).sum() + 1, (delta >= 0).sum() + 1) / 451))


def test_states_of_answers(spark):
    cases = [
        (("success", "ok", "propose", "v", "d"), "valid"), (("failed", "ok", "propose", "v", "d"), "provider_failure"), (("ok", "provider_error", "propose", "v", "d"), "provider_failure"), ((None, None, None, None, None), "provider_failure"),
        (("completed", " No_JSON_object", "propose", "v", "d"), "parse_failure"), (("ok", "duplicate_cell_id", "propose", "v", "d"), "parse_failure"), (("ok", "ok", None, "v", "d"), "missing"), (("ok", "missing_cell", "propose", "v", "d"), "missing"),
        (("ok", "ok", "Abstain", "v", "d"), "abstain"), (("ok", "ok", "propose", None, "d"), "empty"), (("ok", "partial", "propose", "d", "d"), "unchanged"), (("ok", "odd", "propose", "v", "d"), "other_invalid"), (("ok", "ok", "other", "v", "d"), "other_invalid"),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, status string, parse string, decision string, prediction string, dirty string")
    got = df.select("i", groups.failure_state(*(F.col(c) for c in ("status", "parse", "decision", "prediction", "dirty"))).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [s for _, s in cases]
