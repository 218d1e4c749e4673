"""Leaf orders of many different texts: the contract on ties, n-grams that are made once for equal texts, and the time they take."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmend.operators import grouping, workflow
from test_contracts import _leaf_order_plain


@pytest.mark.parametrize("seed", range(12))
def test_entries_give_the_order_of_the_contract(seed):
    """Few values, so that many pairs are equally near and columns are alike."""
    rng = np.random.default_rng(seed)
    x = (rng.random((18, 9)) < 0.4) * rng.choice([1.0, 2.0], 9)
    ids = [f"k{i:02d}" for i in rng.permutation(18)]
    row, col = np.nonzero(x)
    want = _leaf_order_plain(ids, dict(zip(ids, x)))
    for vectors in (x, (row, col, x[row, col])):
        assert grouping.average_linkage_order([[i] for i in ids], vectors) == want


@pytest.mark.parametrize("searches", [0, 1, 16])
@pytest.mark.parametrize("seed", range(6))
def test_searched_together_or_along_a_chain(monkeypatch, seed, searches):
    """Clusters searched together in small blocks, or one by one once there were too many searches, make the same tree."""
    monkeypatch.setattr(grouping, "SEARCHES", searches)
    monkeypatch.setattr(grouping, "BLOCK", 200)
    rng = np.random.default_rng(seed)
    x = (rng.random((60, 150)) < 0.05) * rng.choice([1.0, 2.0], 150)
    ids = [f"k{i:02d}" for i in rng.permutation(60)]
    row, col = np.nonzero(x)
    assert grouping.average_linkage_order([[i] for i in ids], (row, col, x[row, col])) == _leaf_order_plain(ids, dict(zip(ids, x)))


def test_time_of_many_texts():
    texts = [f"name=customer#{i:09d} | segment=x | nation={i % 25}" for i in range(0, 21000, 7)]
    grams = [Counter(t[i : i + k] for k in range(2, 6) for i in range(len(t) - k + 1)) for t in texts]
    df = Counter(g for own in grams for g in own)
    place = {g: i for i, g in enumerate(df)}
    row = np.repeat(np.arange(len(texts)), [len(own) for own in grams])
    col = np.array([place[g] for own in grams for g in own])
    weight = np.array([(1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + df[g])) + 1) for own in grams for g, n in own.items()])
    began = time.process_time()
    got = grouping.average_linkage_order([[t] for t in texts], (row, col, weight))
    assert sorted(got) == texts and time.process_time() - began < 30  # with distances to all others in all terms: minutes


def test_texts_are_searched_together(monkeypatch):
    """Fewer sums of products than texts; one by one there were three a text."""
    texts = [f"name=customer#{i:09d} | segment=x | nation={i % 25}" for i in range(0, 7000, 7)]
    grams = [sorted({t[i : i + k] for k in range(2, 6) for i in range(len(t) - k + 1)}) for t in texts]
    place = {g: i for i, g in enumerate(sorted({g for own in grams for g in own}))}
    row, col = np.repeat(np.arange(len(texts)), [len(own) for own in grams]), np.array([place[g] for own in grams for g in own])
    weight, calls, real = np.random.default_rng(0).random(len(place)) + 0.1, [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    got = grouping.average_linkage_order([[t] for t in texts], (row, col, weight[col]))
    assert sorted(got) == texts and len(calls) < len(texts)


@pytest.mark.parametrize("limit", [0, 300_000])
def test_lists_hold_the_weights_of_the_terms(spark, limit):
    """Whether the terms go to the texts or meet them by a join; a text without terms, and two corpora in one batch."""
    df = spark.createDataFrame([("a", "ab cd ab", "p", 2), ("b", "Ab", "q", 1), ("c", "", "p", 1), ("d", None, "q", 1), ("e", "né ab", "p", 1)], "key string, text string, of string, times int").coalesce(1)
    want = {(r.key, r.h): r.w for r in grouping.term_weights(df, "key", "text", corpus="of", times="times").withColumn("h", F.xxhash64("term")).collect()}
    got = grouping.term_lists(df, "key", "text", corpus="of", times="times", limit=limit).collect()
    assert {r.key for r in got} == set("abcde") and not any(len(r.terms) for r in got if r.key in "cd")
    assert {(r.key, t): w for r in got for t, w in zip(r.terms, r.weights)} == want


def test_texts_of_one_key_are_counted_together(spark):
    df = spark.createDataFrame([("a", "abab"), ("a", "ab"), ("b", "abc")], "key string, text string")
    got = {(r.key, r.term): r.w for r in grouping.term_weights(df, "key", "text", 2, 2).collect()}
    assert set(got) == {("a", "ab"), ("a", "ba"), ("b", "ab"), ("b", "bc")}
    assert got["a", "ab"] == pytest.approx((1 + np.log(3)) * (np.log(4 / 3) + 1)) and got["b", "bc"] == pytest.approx(np.log(4 / 2) + 1)


def test_equal_texts_count_as_often_as_they_are(spark):
    texts = [("a", "ab cd", "p"), ("b", "ab cd", "p"), ("c", "abc", "p"), ("d", "abc", "q")]
    each = spark.createDataFrame(texts, "key string, text string, of string")
    once = each.groupBy("of", "text").agg(F.min("key").alias("key"), F.count("*").alias("times"))
    got = {(r.key, r.term): round(r.w, 9) for r in grouping.term_weights(once, "key", "text", corpus="of", times="times").collect()}
    want = {(r.key, r.term): round(r.w, 9) for of in "pq" for r in grouping.term_weights(each.where(F.col("of") == of), "key", "text").collect()}
    assert got == {k: w for k, w in want.items() if k[0] != "b"}


def test_forms_of_large_and_small_buckets(spark):
    items = spark.createDataFrame([("x", "k2", "f"), ("x", "k1", "g"), ("y", "k1", "f"), ("y", "k3", "g"), ("y", "k2", "f")], "b string, k string, form string")
    vectors = workflow.packed(spark.createDataFrame([("f", "s", 1.0), ("g", "t", 1.0)], "form string, term string, w double"), "form")
    assert {r.b: r.ordered for r in workflow.form_orders(items, ["b"], "k", "form", vectors).collect()} == {"x": ["k1", "k2"], "y": ["k1", "k2", "k3"]}


@pytest.mark.parametrize("seed", range(8))
def test_nearest_by_rare_columns(monkeypatch, seed):
    """The order of the contract where the nearest are looked for among clusters that share a rare column, whatever the limits."""
    monkeypatch.setattr(grouping, "LEAST", 2)
    monkeypatch.setattr(grouping, "RARE", [4, 8][seed % 2])
    monkeypatch.setattr(grouping, "BESIDES", [2, 64][seed // 2 % 2])
    monkeypatch.setattr(grouping, "BLOCK", [200, 1_000_000][seed // 4])
    rng = np.random.default_rng(seed)
    x = (rng.random((80, 200)) < 0.05) * rng.choice([1.0, 2.0, 9.0], 200)
    x[40:] = x[:40] * (rng.random((40, 200)) < 0.9)  # near ones, and some rows without length
    ids = [f"k{i:02d}" for i in rng.permutation(80)]
    row, col = np.nonzero(x)
    assert grouping.average_linkage_order([[i] for i in ids], (row, col, x[row, col])) == _leaf_order_plain(ids, dict(zip(ids, x)))


def test_texts_with_rare_grams_are_not_compared_with_all(monkeypatch):
    """The first search lays out few cosines of all with all."""
    monkeypatch.setattr(grouping, "LEAST", 1000)
    texts = [f"name={i:06x}{i * 7919 % 999983:06d} | {c}" for i in range(0, 7000, 7) for c in ("a", "b")]
    grams = [sorted({t[i : i + k] for k in range(2, 6) for i in range(len(t) - k + 1)}) for t in texts]
    df = Counter(g for own in grams for g in own)
    place = {g: i for i, g in enumerate(df)}
    row, col = np.repeat(np.arange(len(texts)), [len(own) for own in grams]), np.array([place[g] for own in grams for g in own])
    weight = np.log((1 + len(texts)) / (1 + np.array(list(df.values())))) + 1
    laid, real = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: (laid.append(k.get("minlength", 0)), real(*a, **k))[1])
    got = grouping.average_linkage_order([[t] for t in texts], (row, col, weight[col]))
    assert sorted(got) == sorted(texts) and sum(laid) < len(texts) ** 2  # all with all once, and more, before


def test_sets_of_cells_meet_without_sorting(spark):
    cells = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "c")], "dataset string, cell_id string")
    orders = [(view, spark.createDataFrame([("d", of)], "dataset string, ordered array<string>")) for view, of in (("z", ["b", "a", "c"]), ("row", ["a", "b"]))]
    got = workflow.group_actions(cells, orders, [2])
    assert {(r.view, *r.cell_ids): r.size for r in got.collect()} == {("singleton", "a"): 1, ("singleton", "b"): 1, ("singleton", "c"): 1, ("row", "a", "b"): 2, ("z", "a", "c"): 2}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
