"""Repeated deliveries against a plain grouping."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cellmend.operators import deliveries
from cellmend.operators.deliveries import RepeatedDeliveries, _Filter

SCHEMA = "delivery_id long, received_at timestamp, query_id string, prompt_hash string, provider_request_hash string, k1 string"


def _op(spark, buckets=8):
    return RepeatedDeliveries(spark, ["query_id", "prompt_hash", "provider_request_hash"], "query_id", ("provider_request_hash",), buckets)


def _rows(n, seed, hot):
    rng = random.Random(seed)
    start = datetime(2024, 5, 6)
    out = []
    for i in range(n):
        m = 0 if rng.random() < hot else rng.randrange(1, n)
        q, p, r = f"{m:024x}", f"{m * 7:064x}", [f"{m * 13:064x}", None, "", "  "][m % 4 if m % 5 == 0 else 0]
        q, p = rng.choice([q, q.upper(), f" {q}"]), rng.choice([p, f"sha256:{p}", f"SHA256:{p.upper()} "])
        if r is not None and not r.strip():
            r = rng.choice([None, "", " "])
        at = None if rng.random() < 0.02 else start + timedelta(seconds=rng.randrange(5000))
        out.append((i, at, None if rng.random() < 0.03 else q, None if m % 11 == 0 else p, r, "clash"))
    return out


def _plain(rows):
    import re

    can = lambda x: None if x is None else re.sub("^[a-z0-9]+:", "", x.strip().lower())
    groups = defaultdict(list)
    for i, at, q, p, r, _ in rows:
        if q is not None:
            groups[can(q), can(p), can(r) or None].append((at or datetime.max, i))
    return sorted({i for g in groups.values() for at, i in g if (at, i) != min(g)})


@pytest.mark.parametrize(("n", "hot"), [(1200, 0.0), (900, 0.4)])
def test_against_plain_grouping(spark, n, hot, monkeypatch):
    monkeypatch.setattr(deliveries, "HOT_LEAST", 50)
    rows = _rows(n, n, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = _plain(rows)
    assert sorted(r[0] for r in _op(spark).repeats(df).collect()) == expected
    assert sorted(r.delivery_id for r in _op(spark, 1).messages(df).collect()) == sorted({r[0] for r in rows} - set(expected))


def test_empty_and_repeated_rows(spark):
    assert _op(spark).repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    one = (1, datetime(2024, 1, 1), "ab", "cd", None, "")
    assert _op(spark).repeats(spark.createDataFrame([one, one], SCHEMA)).collect() == []
    assert _op(spark).repeats(spark.createDataFrame([one, (None, *one[1:])], SCHEMA)).collect() == []
    assert [r[0] for r in _op(spark).repeats(spark.createDataFrame([one, (2, None, "AB", "cd", "", "")], SCHEMA)).collect()] == [2]


def test_verification_reads_only_folders_of_matching_time_buckets(spark):
    from cellmend.session import Stages

    start = datetime(2024, 5, 6)
    rows = [(i, start + timedelta(seconds=i), f"{i:024x}", "p", None, "") for i in range(800)]
    rows += [(1000 + i, start + timedelta(seconds=700 + i), f"{100 + i:024x}", "P ", " ", "") for i in range(50)]  # of the first bucket, again in the last
    op, stages = _op(spark, 8), Stages(spark, "test")
    storage = op.stored(stages, op._rows(spark.createDataFrame(rows, SCHEMA)))
    assert storage.count() == 850 and storage.select("bucket").distinct().count() == 8
    noted = [(r.bucket, set(r.noted)) for r in storage.collect() if r.noted]
    assert sum(b == 7 and {1, 7} <= n for b, n in noted) == 50 and len(noted) < 80  # a filter may hold a few more
    matching = storage.where(F.col("bucket").isin([1, 7]))
    plan = matching._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {r[0] for r in matching.select(F.input_file_name()).distinct().collect()}
    assert {f.split("bucket=")[1].split("/")[0] for f in read} == {"1", "7"} and len(read) <= 8 < len(storage.inputFiles())
    assert sorted(r[0] for r in op.repeats(spark.createDataFrame(rows, SCHEMA)).collect()) == list(range(1000, 1050))


def test_filter_forgets_nothing():
    import numpy as np

    rng = np.random.default_rng(1)
    k = rng.integers(0, 2**63, (2, 5000), dtype=np.uint64)
    f = _Filter(k[0], k[1])
    assert f.holds(k[0], k[1]).all()
    other = rng.integers(0, 2**63, (2, 20000), dtype=np.uint64)
    assert f.holds(other[0], other[1]).mean() < 0.01
