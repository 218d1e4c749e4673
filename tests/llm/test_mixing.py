"""The mix: targets, caps, nesting, edges."""

import random

from cellmend.llm.mixing import SourceMix


def _docs(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, "word " * rng.randrange(1, 30) if i % 50 else rng.choice(["", None]), rng.choices(["big", "mid", "small", None, "other"], [60, 25, 5, 5, 5])[0], "clash") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string")


def _targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_caps_and_nesting(spark):
    rows, docs = _docs(spark)
    targets = _targets(spark, [("big", 0.45, 1), ("mid", 0.25, 2), ("small", 0.25, 3), ("absent", 0.05, 2)])
    chosen, report = SourceMix(spark).mix(docs, targets)
    used = {r.doc_id: r.copies for r in chosen.collect()}
    by = {r.source: r for r in report.collect()}
    cap = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= c <= cap[rows[i][2]] for i, c in used.items())
    for s in ("big", "mid"):
        assert by[s].target_reachable and abs(by[s].mix_tokens - by[s].target_tokens) <= 16
    assert not by["small"].target_reachable and by["small"].mix_tokens == 3 * by["small"].source_tokens
    assert by["absent"].mix_tokens == 0 and by["absent"].actual_share == 0
    assert abs(sum(r.actual_share for r in by.values()) - 1) < 1e-9
    smaller = {r.doc_id: r.copies for r in SourceMix(spark, budget=1500).mix(docs, targets)[0].collect()}
    larger = {r.doc_id: r.copies for r in SourceMix(spark, budget=2500).mix(docs, targets)[0].collect()}
    assert all(larger.get(i, 0) >= c for i, c in smaller.items()) and sum(larger.values()) > sum(smaller.values())


def test_same_choice_for_repeated_rows_and_empty_tables(spark):
    _, docs = _docs(spark, 100)
    targets = _targets(spark, [("big", 1.0, None), ("big", 0.5, 2), (None, 0.5, 1)])
    chosen, report = SourceMix(spark, budget=400).mix(docs.unionByName(docs), targets)
    copies = {}
    for r in chosen.collect():
        assert copies.setdefault(r.doc_id, r.copies) == r.copies
    assert [r.source for r in report.collect()] == ["big"]
    empty, report = SourceMix(spark).mix(docs.where("false"), targets)
    assert empty.collect() == [] and report.collect()[0].actual_share == 0
    nothing, report = SourceMix(spark).mix(docs, targets.where("false"))
    assert nothing.collect() == [] and report.collect() == []
