"""Grouped splits: groups stay whole, shares are met, ties follow names of both tables."""

import random

import numpy as np
import pytest

from cellmend.llm import splits
from cellmend.llm.splits import _dealt, place, settle, split_records, stratified


def test_rare_labels_come_first():
    counts = np.array([[10, 0], [10, 0], [8, 1], [9, 1]])  # two labels, the second one rare
    done = place(counts, np.ones(4, dtype=int), np.array([0.5, 0.5]))
    assert (done.sum(axis=1) == 1).all() and (done[2] != done[3]).all() and (done[0] != done[1]).all()


def test_members_of_a_class_are_dealt_as_one_after_the_other():
    rng = random.Random(4)
    for _ in range(300):
        need = np.array([rng.uniform(-5, 30) for _ in range(rng.randrange(1, 6))])
        each, members = rng.choice([1.0, 2.0, 0.5, 7.0]), rng.randrange(1, 40)
        left, plain = need.copy(), np.zeros(need.size, dtype=int)
        for _ in range(members):
            s = max(range(need.size), key=lambda s: (left[s], -s))
            plain[s] += 1
            left[s] -= each
        assert (_dealt(need, np.zeros(need.size), each, members) == plain).all()


@pytest.mark.parametrize("seed", range(6))
def test_shares_are_as_near_as_moves_bring_them(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(8, 40))
    counts = rng.multinomial(1, [0.7, 0.2, 0.1], n) * rng.integers(1, 200, (n, 1)) + rng.integers(0, 3, (n, 3))
    shares = np.array([0.8, 0.1, 0.1])
    done = settle(place(counts, np.ones(n, dtype=int), shares), counts, shares)
    assert (done.sum(axis=1) == 1).all() and (done >= 0).all()
    far = counts.sum(axis=1) @ done - shares * counts.sum()
    near = max(counts.sum(axis=1).min() / 2, splits.NEAR * counts.sum())
    cost = lambda d: (np.maximum(0, np.abs(counts.sum(axis=1) @ d - shares * counts.sum()) - near) ** 2).sum()
    for i in range(n):
        for s in range(3):
            other = done.copy()
            other[i] = 0
            other[i, s] = 1
            assert cost(other) >= cost(done) - 1e-6, (far, i, s)


def _records(spark, n, seed, hot=0.3):
    rng = random.Random(seed)
    rows = [(f"g{0 if rng.random() < hot else rng.randrange(1, 400)}", rng.choice(["x", "x", "x", "y", "z", None])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "grp string, lab string")


@pytest.mark.parametrize(("head", "rows_of_classes"), [(4096, 200_000), (20, 200), (20, 30), (1, 5)])
def test_shares_and_whole_groups(spark, head, rows_of_classes, monkeypatch):
    """All counts exact, then counts of small groups taken to fewer and fewer digits."""
    monkeypatch.setattr(splits, "HEAD", head)
    monkeypatch.setattr(splits, "CLASS_ROWS", rows_of_classes)
    rows, df = _records(spark, 6000, 7)
    got = {r.grp: r.split for r in stratified(spark, df, "grp", "lab", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert set(got) == {g for g, _ in rows}
    for s, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(got[g] == s for g, _ in rows) / 6000 - share) < (0.005 if rows_of_classes > 5 else 0.02)
        for label in ("y", "z"):
            own = [g for g, lab in rows if lab == label]
            assert abs(sum(got[g] == s for g in own) / len(own) - share) < 0.04


def test_ties_and_names(spark):
    records = spark.createDataFrame([("s:A:1:1", " A ", "l", 1), ("s:b:1:1", "b", None, 1), ("s:c:1:1", "C", "l", 1), ("s:d:1:1", None, "l", 1), ("s:e:1:1", "e", "l", 1), ("s:A:1:1", "a", "l", 1), (None, "a", "l", 1)], "cell_id string, dataset string, sample_stratum string, v int")
    evidence = spark.createDataFrame([("a", "F1"), ("B", " f2 "), ("z", "n/a"), ("e", "N/A"), ("e", None), (None, "f1"), ("e", " ")], "dataset string, base_family string")
    heads = spark.createDataFrame([("b", "f1"), ("c", "f2"), ("d", "unknown"), ("e", "c")], "target_dataset string, family_left_out string")
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5), ("none", 0.0), (None, None)], "split_name string, target_share double")
    got = {r.cell_id: (r.group_dataset, r.split) for r in split_records(spark, records, [(evidence, "dataset", "base_family"), (heads, "target_dataset", "family_left_out")], targets).collect()}
    assert {k: v[0] for k, v in got.items()} == {"s:A:1:1": "a", "s:b:1:1": "a", "s:c:1:1": "a", "s:d:1:1": "d", "s:e:1:1": "e"}
    assert got["s:A:1:1"][1] == got["s:b:1:1"][1] == got["s:c:1:1"][1] and {v[1] for v in got.values()} == {"train", "test"}


def test_empty(spark):
    records = spark.createDataFrame([], "cell_id string, dataset string, sample_stratum string")
    none = spark.createDataFrame([], "dataset string, base_family string")
    targets = spark.createDataFrame([("train", 1.0)], "split_name string, target_share double")
    assert split_records(spark, records, [(none, "dataset", "base_family")], targets).collect() == []
    one = spark.createDataFrame([("s:q:1:1", "Q", "l")], "cell_id string, dataset string, sample_stratum string")
    assert [tuple(r) for r in split_records(spark, one, [(none, "dataset", "base_family")], targets).collect()] == [("s:q:1:1", "q", "train")]
    assert [tuple(r) for r in split_records(spark, one, [(none, "dataset", "base_family")], targets.where("false")).collect()] == [("s:q:1:1", "q", None)]
