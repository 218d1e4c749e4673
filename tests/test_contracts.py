"""Contracts of the repair operators on toy inputs."""

import html
import itertools
import math
import random
from collections import deque
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cellmend.functions import scalars as S
from cellmend.operators import audit, cells, gate, grouping, ledger, metrics, profiles, prompts, rules, selection, statistics, verify, workflow

ABC = ["a", "b", "c", "d", "e", "f", "g"]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scalars(spark):
    values = [None, "", " \t\n", "a&amp;lt;b", "&amp;amp;", "x \n\t y", " x ", "a\rb", "3.5", "-.5", "1,2", "2020-01-02", "1/2/20", "3:05 P.M.", "a@b.c", "www.x.y", "YES", "Ab-12  cd", "--..", "é²x", "x" * 200, "日本 abc"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    n = S.normalize_value(F.col("v"))
    got = rows(df.select(n, S.value_type(n), S.format_signature(n), S.bounded(n), S.token_estimate(n)))
    import re

    for v, (norm, kind, shape, short, tokens) in zip(values, got):
        want = re.sub("[\t\n ]+", " ", html.unescape(v or "")).strip("\t\n ")
        assert norm == want
        mapped = ["A" if c.isalpha() else "9" if c.isdigit() else "_" if c.isspace() else c for c in want[:80]]
        assert shape == ("".join(c for c, _ in itertools.groupby(mapped))[:40] or "EMPTY"), v
        assert short == (want if len(want) <= 160 else want[:159] + "…")
        cjk = sum("一" <= c <= "鿿" for c in want)
        assert tokens == max(1, cjk + math.ceil(len("".join(c for c in want if not "一" <= c <= "鿿").encode()) / 4))
    assert [g[1] for g in got] == ["empty", "empty", "empty", "text", "text", "text", "text", "text", "number", "number", "text", "date", "date", "time", "email", "url", "boolean", "text", "text", "text", "text", "text"]


def test_ngrams_and_units(spark):
    got = spark.createDataFrame([("Ab  c",), ("",), ("x",)], "t string").select(S.char_ngrams(F.col("t"), 2, 3)).collect()
    assert [sorted(r[0]) for r in got] == [sorted(["ab", "b ", " c", "ab ", "b c"]), [], []]
    units = spark.createDataFrame([(5e-16,), (1.5e-15,), (0.3,), (None,)], "x double").select(S.exact_units(F.col("x"))).collect()
    assert [None if r[0] is None else int(r[0]) for r in units] == [0, 2, 3 * 10**14, None]


def test_cells_masks_annotations(spark):
    dirty = spark.createDataFrame([(0, "a", "x"), (1, "b", None)], "r int, p string, q string")
    clean = spark.createDataFrame([(0, "a", "y"), (1, "c", "")], "r int, one string, two string")
    pairs = cells.cell_pairs(dirty, clean, "r", ["p", "q"], "s", "d", ["one", "two"])
    bad = cells.errors(pairs)
    assert sorted(r.cell_id for r in bad.collect()) == ["s:d:0:1", "s:d:1:0"]
    assert not {"clean_value", "error_type"} & set(cells.online_view(bad).columns)
    assert dict(rows(cells.masked_rows(dirty, bad, "r", ["p", "q"]))) == {"s:d:0:1": f"p=a | q={cells.TARGET_MASK}", "s:d:1:0": f"p={cells.TARGET_MASK} | q="}
    log = spark.createDataFrame([(1, "d", "0", "q", "typo", None, "0"), (2, "d", "0", "q", "late", None, "0"), (3, "d", "x", "q", "bad", None, "0")], "log_id long, dataset string, row_id string, column_name string, error_type string, right_value string, missing_value string")
    assert sorted((r.cell_id, r.error_type) for r in cells.annotate(bad, log).collect()) == [("s:d:0:1", "late"), ("s:d:1:0", None)]


def test_conflicts_equal_pairwise_count(spark):
    rng = random.Random(4)
    table = [(i, rng.choice(["1", "2", ""]), rng.choice(["u", "v"]), rng.choice(["p", "q", ""])) for i in range(60)]
    asked = [(i, c, rng.choice(["1", "2", "9", "p", "q", "", "u"])) for i in range(60) for c in ("k", "m", "d")]
    t = spark.createDataFrame(table, "row_idx int, k string, m string, d string")
    got = {(r.row_idx, r.column_name): (r.fd_before, r.fd_after) for r in rules.conflicts(t, spark.createDataFrame(asked, "row_idx int, column_name string, candidate string"), "row_idx", ["k", "m"], "d").collect()}

    def plain(i, own):
        return 0 if "" in own else sum(j != i and "" not in r and r[:2] == own[:2] and r[2] != own[2] for j, *r in ((x[0], *[list(x[1:])][0]) for x in table))

    for i, c, v in asked:
        own = list(table[i][1:])
        new = [v if n == c else x for n, x in zip(("k", "m", "d"), own)]
        assert got[i, c] == (plain(i, own), plain(i, new)), (i, c, v)


def test_groups_and_dominant(spark):
    t = spark.createDataFrame([(0, "z", "a1"), (1, "z", "b"), (2, "z", "a2"), (3, "w", "c"), (4, "v", ""), (5, "v", "x")], "r int, k string, v string")
    assert rows(rules.violating_groups(t, ["k"], "v").orderBy("k")) == [("v", 2, 2, 1), ("z", 3, 3, 3)]
    d = profiles.dominant(t.withColumn("one", F.lit(1)), ["one"], "v", "r").first()
    assert (d.dominant_type, d.dominant_format) == ("text", "A") and abs(d.empty_share - 1 / 6) < 1e-9
    empty = profiles.dominant(spark.createDataFrame([(0, ""), (1, "")], "r int, v string").withColumn("one", F.lit(1)), ["one"], "v", "r").first()
    assert (empty.dominant_type, empty.dominant_format) == ("empty", "EMPTY")


def test_similar_rows_equal_plain_count(spark, monkeypatch):
    rng = random.Random(8)
    names = ["a", "b", "c", "d"]
    table = [(i, *(rng.choice(["x", "y", ""]) for _ in names)) for i in range(40)]
    bad = sorted({(rng.randrange(40), rng.randrange(4)) for _ in range(25)})
    t = spark.createDataFrame(table, "r int, a string, b string, c string, d string")
    found = spark.createDataFrame([(f"{i}:{j}", i, j) for i, j in bad], "cell_id string, row_idx int, col_idx int")
    got = {(r.cell_id, r["rank"]): (r.similar_row, r.matches) for r in profiles.similar_rows(t, found, found, "r", names, 3).collect()}
    monkeypatch.setattr(profiles, "COMBINED", 2)  # as a table of many columns
    monkeypatch.setattr(profiles, "TARGET_BLOCK", 5)
    monkeypatch.setattr(profiles, "ROW_BLOCK", 7)
    assert got == {(r.cell_id, r["rank"]): (r.similar_row, r.matches) for r in profiles.similar_rows(t, found, found, "r", names, 3).collect()}
    for i, j in bad:
        scores = {}
        for q in range(40):
            if q != i and (q, j) not in bad:
                n = sum(c != j and (i, c) not in bad and (q, c) not in bad and table[i][c + 1] == table[q][c + 1] for c in range(4))
                if n:
                    scores[q] = n
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [got.get((f"{i}:{j}", k + 1)) for k in range(len(best))] == best


BASE = dict(parse_status="ok", decision="propose", candidate="Rome", dirty_value="Paris", fallback="Lyon", confidence=0.9, uplift=0.5, dominant_type="text", dominant_format="A", candidate_support=3, fallback_support=0, fd_before=3, fd_after=1)


def test_verifier(spark):
    cases = [
        ({}, "accepted"), (dict(candidate=""), "empty_repair"), (dict(candidate="Paris"), "unchanged_dirty_value"), (dict(candidate="Lyon"), "equivalent_to_base"), (dict(confidence=0.54), "low_llm_confidence"),
        (dict(uplift=0.0), "non_positive_predicted_gain"), (dict(fd_after=4), "public_fd_worse"), (dict(parse_status="failed"), "invalid_llm_output"), (dict(decision="abstain"), "fallback_decision"), (dict(decision=None), "fallback_decision"),
        (dict(candidate=None), "missing_repair"), (dict(dominant_type="number", dominant_format="9", fallback="12", candidate="Rome", fd_before=0, fd_after=0), "type_worse_than_base"),
        (dict(dominant_type="number", dominant_format="9.9", fallback="1.2", candidate="12", fd_before=0, fd_after=0), "format_worse_than_base"), (dict(confidence=0.6, uplift=0.01, fd_before=0, fd_after=0), "verification_score_below_threshold"),
        (dict(candidate_support=0, fd_before=0, fd_after=0), "no_comparative_signal"), (dict(candidate_support=None, fallback_support=None, fd_before=None, fd_after=None), "no_comparative_signal"),
        (dict(uplift=None), "non_positive_predicted_gain"), (dict(uplift=float("nan")), "non_positive_predicted_gain"), (dict(confidence=None), "low_llm_confidence"),
        (dict(candidate_support=0, fd_before=0, fd_after=0, dominant_type="number", dominant_format="9", candidate="12", fallback="Lyon"), "accepted"),
        (dict(candidate_support=0, fd_before=0, fd_after=0, dominant_type="number", dominant_format="9", candidate="12", fallback="1.2"), "accepted"),
    ]
    df = spark.createDataFrame([Row(i=i, **(BASE | c)) for i, (c, _) in enumerate(cases)], "i int, parse_status string, decision string, candidate string, dirty_value string, fallback string, confidence double, uplift double, dominant_type string, dominant_format string, candidate_support long, fallback_support long, fd_before long, fd_after long")
    got = verify.decide(df).orderBy("i").collect()
    assert [g.reason for g in got] == [r for _, r in cases]
    # without the demand for a comparison the same candidates are judged by their score
    assert [g.reason for g in verify.decide(df, comparative=False).orderBy("i").collect() if cases[g.i][1] == "no_comparative_signal"] == ["accepted"] * 2
    # a score of exactly the threshold is enough: 0.4 * 0.75 + 0.25 * 0 + 0.1 + 0.05 + 0.1
    assert {r.reason for r in verify.decide(df.limit(1).withColumns({"confidence": F.lit(0.75), "uplift": F.lit(1e-300), "fd_after": F.lit(3)}), acceptance=0.4 * 0.75 + 0.25 * 0.0 + 0.10 + 0.05 + 0.10).collect()} == {"accepted"}
    assert got[0].score == 0.96 and got[0].final_prediction == "Rome" and {g.final_prediction for g in got[1:3]} == {"Lyon"}


def test_arbitration_order(spark):
    four = [("z9", 2, 1), ("size", 1, 2), ("z", 1, 1), ("a", 1, 1)]
    df = spark.createDataFrame([("c", q, float(u), cost, size, ok, q.upper(), "Lyon") for u in (0.4,) for q, cost, size in four for ok in (True,)] + [("n", "q", 0.9, 1, 1, False, "X", "Lyon")], "cell_id string, query_id string, uplift double, query_cost int, query_size int, accepted boolean, candidate string, fallback string")
    assert {r.cell_id: (r.query_id, r.final_prediction, r.final_source) for r in verify.arbitrate(df).collect()} == {"c": ("a", "A", "llm"), "n": (None, "Lyon", "base")}
    assert rows(spark.range(1).select(verify.fallback_value(F.lit("failed"), F.lit("b"), F.lit("d")), verify.fallback_value(F.lit("ok_x"), F.lit("b"), F.lit("d")))) == [("d", "b")]


def _answer(*items, query="q1"):
    import json

    return "noise {bad} " + json.dumps({"query_id": query, "repairs": list(items)}) + " tail"


def _item(cell, **more):
    return dict(cell_id=cell, repair="r", confidence="0.9", decision="Propose", evidence="e") | more


def test_answers(spark):
    parse = ledger.parse_answer
    out = parse(_answer(_item("c1"), _item("c2"), _item("c2"), _item("zzz")), "q1", ["c1", "c2"])
    assert (out["parse_status"], [i["cell_id"] for i in out["items"]], out["missing"], out["duplicate"], out["unknown"]) == ("partial", ["c1"], ["c2"], ["c2"], ["zzz"])
    assert parse(_answer(_item("c1", affected_constraints=["f", " "]), _item("c2", confidence=0)), "q1", ["c2", "c1"])["parse_status"] == "ok"
    assert parse("nothing", "q1", ["c1"])["parse_status"] == "no_json_object" and parse("{", "q1", [], True)["parse_status"] == "incomplete_or_invalid_json"
    assert parse(_answer(query="q2"), "q1", ["c1"])["parse_status"] == "query_id_mismatch"
    for bad, status in ((dict(confidence=True), "invalid_confidence"), (dict(confidence="nan"), "confidence_out_of_range"), (dict(confidence=1.1), "confidence_out_of_range"), (dict(repair=3), "invalid_repair"), (dict(decision="maybe"), "invalid_decision"), (dict(evidence=None), "invalid_evidence"), (dict(affected_constraints=[1]), "invalid_affected_constraints")):
        out = parse(_answer(_item("c1", **bad)), "q1", ["c1"])
        assert out["parse_status"] == "no_valid_items" and out["invalid"][0]["status"] == status
    df = spark.createDataFrame([("q1", _answer(_item("c1")), ["c1"]), ("q1", None, None)], "query_id string, response_text string, cell_ids array<string>")
    assert [r.parsed.parse_status for r in ledger.parse_responses(df).collect()] == ["ok", "no_json_object"]
    once = ledger.once_per_cell(spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3)], "q string, c string, v int"), ["q", "c"])
    assert rows(once) == [("q", "b", 3)]


def test_ledgers(spark):
    df = spark.createDataFrame([("q1", 0, 1, "success", "old"), ("q1", 0, 2, "success", "latest"), ("q2", 0, 3, "failed", "x"), ("q1", 1, 1, "success", "other"), ("q2", 1, 2, "success", "recovered"), ("q3", 0, 1, "failed", "a"), ("q3", 0, 2, None, "b")], "q string, source int, i int, status string, text string")
    bank = ledger.response_bank(df, ["q"], F.col("source"), F.col("i"))
    assert {r.q: r.text for r in bank.collect()} == {"q1": "latest", "q2": "recovered", "q3": "b"}
    assert {r.q: r.text for r in ledger.latest(df, ["q"], ["source", "i"]).collect()} == {"q1": "other", "q2": "recovered", "q3": "b"}
    merged = workflow.merged_ledger([("old", df.where("source = 0").withColumnRenamed("i", "row_index")), ("new", df.where("source = 1").withColumnRenamed("i", "row_index"))], ["q"])
    assert {r.q: (r.text, r.fresh) for r in merged.collect()} == {"q1": ("other", True), "q2": ("recovered", True), "q3": ("b", False)}
    assert sorted(r.q for r in ledger.still_to_ask(df.select("q").distinct(), df, ["q"]).collect()) == ["q3"]


def test_metrics_scopes(spark):
    data = [("m", d, ok, good) for d, n in (("a", 4), ("b", 1)) for i in range(n) for ok, good in [(i % 2 == 0, i == 0)]]
    df = spark.createDataFrame([Row(method_name=m, scenario="main", backend="none", budget_share=None, group_size_variant="all", suite="s", dataset=d, ok=ok, good=good) for m, d, ok, good in data], "method_name string, scenario string, backend string, budget_share double, group_size_variant string, suite string, dataset string, ok boolean, good boolean")
    got = {r.scope if r.scope != "dataset" else r.dataset: r for r in metrics.summarize(df, F.col("ok"), F.col("good")).collect()}
    assert (got["a"].precision, got["a"].recall, got["b"].f1) == (0.5, 0.25, 1.0)
    assert got["micro"].correct_repairs == 2 and abs(got["micro"].precision - 2 / 3) < 1e-12
    assert abs(got["macro"].f1 - (got["a"].f1 + 1) / 2) < 1e-12 and got["macro"].true_error_cells == 5
    curve = spark.createDataFrame([("k", 0.1, 0.6, 0.5), ("k", 0.2, 0.7, 0.5), ("short", 0.1, 0.6, 0.5)], "k string, x double, y double, a double")
    assert [(r.k, round(r.area, 9)) for r in metrics.budget_curve_area(curve, ["k"], "x", "y", "a", 0.2).collect()] == [("k", 0.6)]


def test_quadrants_and_rates(spark):
    four = spark.createDataFrame([("s", "d", a, b) for a in (True, False) for b in (True, False)], "suite string, dataset string, a boolean, b boolean")
    q = metrics.quadrants(four, F.col("a"), F.col("b"), [["suite", "dataset"], []])
    assert sorted(rows(q)) == [("ALL", "ALL", 1, 1, 1, 1), ("s", "d", 1, 1, 1, 1)]
    r = metrics.complementarity_rates(q).first()
    assert (r.base_accuracy, r.llm_accuracy, r.union_accuracy, r.net) == (0.5, 0.5, 0.75, 0.0)
    ranks = metrics.nearest_rank(spark.createDataFrame([("k", i) for i in (5, 1, 1, 3)] + [("k", None)], "k string, v int"), ["k"], "v", [0.5, 0.9])
    assert rows(ranks) == [("k", 4, 1, 5)]
    o = audit.set_overlap(spark.createDataFrame([("d", str(i), i < 5, i == 0) for i in range(5)], "d string, c string, a boolean, b boolean"), ["d"], F.col("a"), F.col("b"), "c").first()
    assert (o.of_a, o.of_b, o.jaccard) == (0.2, 1.0, 0.2)


def test_statistics(spark):
    def plain(a, b):
        n, k = a + b, min(a, b)
        return min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n))) if n and 2 * k != n else 1.0

    assert all(statistics.exact_mcnemar(a, b) == pytest.approx(plain(a, b), rel=1e-12) for a in range(30) for b in range(30))
    assert statistics.exact_mcnemar(1100, 1000) == pytest.approx(plain(1100, 1000), rel=1e-9)
    p = spark.createDataFrame([("f", n, x) for n, x in zip("abcd", (0.01, 0.04, 0.03, 0.5))], "f string, n string, p double")
    assert {r.n: round(r.p_holm, 9) for r in metrics.holm(p, ["f"], "p", "n").collect()} == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5}
    data = [("k", f"c{i % 7}", float(i % 5)) for i in range(50)]
    r = statistics.bootstrap_means(spark.createDataFrame(data, "k string, c string, v double"), ["k"], "c", "v", 200, 45).first()
    rng, groups = np.random.default_rng(45), [[v for _, c, v in data if c == f"c{i}"] for i in range(7)]
    draws = []
    for _ in range(200):
        pick = [groups[i] for i in rng.integers(0, 7, size=7)]
        draws.append(sum(map(sum, pick)) / sum(map(len, pick)))
    assert (r.low, r.high) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975]))) and r.clusters == 7
    assert all(math.isnan(x) for x in statistics.percentile_interval([math.nan]))
    w = statistics.multiplier_draws([np.array([0, 0, 1]), np.array([0, 1, 1])], [2, 2], np.array([1.0, 2.0, 3.0]), 50, 1)
    rng = np.random.default_rng(1)
    for x in w:
        a, b = rng.exponential(1.0, 2), rng.exponential(1.0, 2)
        ws = np.array([a[0] * b[0], a[0] * b[1], a[1] * b[1]])
        assert x == pytest.approx((ws * [1, 2, 3]).sum() / ws.sum())


def test_windows_blocks_schedule(spark):
    df = spark.createDataFrame([(ABC,), (["a"],), ([],)], "o array<string>").select(grouping.exact_windows(F.col("o"), 4).alias("w"))
    assert [["".join(w) for w in r.w] for r in df.collect()] == [["abcd", "cdef", "defg"], [], []]
    q = [(c, i) for c, n in (("x", 3), ("y", 1), ("z", 2)) for i in range(n)]
    got = workflow.schedule_index(spark, grouping.round_robin_schedule(spark, spark.createDataFrame(q, "c string, i int"), "c", "i", 9))
    order = sorted({c for c, _ in q})
    random.Random(9).shuffle(order)
    queues, plain = deque((c, deque(i for d, i in q if d == c)) for c in order), []
    while queues:
        c, own = queues.popleft()
        plain.append((c, own.popleft()))
        if own:
            queues.append((c, own))
    assert [(r.c, r.i) for r in got.orderBy("logical_index").collect()] == plain
    assert sorted(r.logical_index for r in got.collect()) == list(range(6))
    assert all(x != i for s in range(20) for i, x in enumerate(grouping.derangement(5, s)))


def _leaf_order_plain(ids, vec):
    """The contract by plain means: clusters as tuples of ids in sorted order."""
    def dist(a, b):
        x, y = np.array(vec[a], float), np.array(vec[b], float)
        nx, ny = np.linalg.norm(x), np.linalg.norm(y)
        return 1 - (1.0 if nx == ny == 0 else 0.0 if not nx or not ny else float(np.clip(x @ y / nx / ny, -1, 1)))

    clusters = [(i,) for i in sorted(ids)]
    mean = lambda a, b: sum(dist(x, y) for x in a for y in b) / len(a) / len(b)
    while len(clusters) > 1:
        a, b = min(itertools.combinations(clusters, 2), key=lambda p: (round(mean(*p), 9), *sorted((min(p[0]), min(p[1])))))
        d1, d2 = dist(a[-1], b[0]), dist(b[-1], a[0])
        joined = a + b if d1 < d2 - 1e-12 else b + a if d2 < d1 - 1e-12 else min(a + b, b + a)
        clusters = [c for c in clusters if c not in (a, b)] + [joined]
    return list(clusters[0])


def test_leaf_order(spark):
    rng = np.random.default_rng(3)
    vec = {f"k{i:02d}": rng.normal(size=4).tolist() for i in range(14)} | {"zero": [0.0] * 4}
    got = grouping.leaf_orders(spark.createDataFrame([("b", k, v) for k, v in vec.items()], "b string, k string, v array<double>"), ["b"], "k", "v").first().ordered
    assert got == _leaf_order_plain(vec, vec)
    terms = spark.createDataFrame([(k, f"t{j}", float(x)) for k, v in vec.items() for j, x in enumerate(v) if x], "k string, term string, weight double")
    items = spark.createDataFrame([("b", k) for k in vec], "b string, k string")
    assert workflow.sparse_leaf_orders(items, ["b"], "k", terms).first().ordered == got
    parts = workflow.sparse_leaf_orders(items, ["b"], "k", terms, largest=4).collect()
    assert sorted(k for p in parts for k in p.ordered) == sorted(vec) and len(parts) > 1


def test_selection():
    tie = ({"q0": {"s": 3, "b": 7}, "qa": {"s": 3, "a": 2}, "qb": {"s": 2, "b2": 2}}, {"q0": 1, "qa": 1, "qb": 1}, 2)
    assert [q for q, _ in selection.greedy(*tie)[0]] == ["q0", "qa"]
    assert selection.greedy({"a": {"x": 2}, "b": {"y": 100}}, {"a": 1, "b": 100}, 100)[2] == "best_single"
    rng = random.Random(4815162342)
    for _ in range(150):
        n = rng.randint(2, 9)
        pairs = {f"q{i}": {f"c{c}": rng.randint(0, 50) for c in rng.sample(range(8), rng.randint(1, 8))} for i in range(n)}
        costs = {q: rng.randint(1, 9) for q in pairs}
        budget = rng.randint(1, 25)
        lazy, eager = selection.greedy(pairs, costs, budget), selection.greedy(pairs, costs, budget, lazy=False)
        assert lazy == eager and sum(costs[q] for q, _ in lazy[0]) <= budget
        assert lazy[1] >= 0.405 * selection.exhaustive(pairs, costs, budget)


def test_select_queries(spark):
    df = spark.createDataFrame([("d", "q0", "s", 3, 1), ("d", "q0", "b", 7, 1), ("d", "qa", "a", 2, 1), ("e", "q0", "x", 1, 5)], "dataset string, query_id string, cell_id string, gain_units int, query_cost long").withColumn("budget", F.lit(1))
    assert [(r.dataset, r.query_id, int(r.gain_units)) for r in selection.select_queries(df, ["dataset"]).collect()] == [("d", "q0", 10)]
    assert rows(selection.objective_value(df, ["dataset"]).orderBy("dataset")) == [("d", 12, 3), ("e", 1, 1)]


def test_prompts(spark):
    c = spark.createDataFrame([("d", ["b", "a"])], "dataset string, ids array<string>")
    r = c.select(prompts.query_id(F.col("dataset"), F.col("ids")), prompts.query_id(F.col("dataset"), F.reverse("ids")), prompts.ordered_query_id(F.col("dataset"), F.col("ids")), prompts.ordered_query_id(F.col("dataset"), F.reverse("ids"))).first()
    assert r[0] == r[1] and r[2] != r[3] and len(r[0]) == 24
    leak = spark.createDataFrame([('{"a": {"Clean_Value" : 1}}',), ('{"a": "clean_value"}',)], "p string").select(prompts.leaks(F.col("p"))).collect()
    assert [x[0] for x in leak] == [True, False]


def test_audits(spark):
    a = spark.createDataFrame([(i, str(i), None if i == 3 else "x") for i in range(6)], "k int, v string, w string")
    b = a.where("k > 0").withColumn("v", F.when(F.col("k") == 2, "new").otherwise(F.col("v"))).withColumn("w", F.when(F.col("k") == 4, None).otherwise(F.col("w")))
    assert sorted(rows(audit.field_differences(a, b, ["k"], ["v", "w"]))) == [(2, "v", "2", "new"), (4, "w", "x", None)]
    assert rows(audit.coverage(a, b, ["k"])) == [(0, "missing")]
    cols = [F.col(c) for c in a.columns]
    one, two = audit.content_digest(a, cols).first(), audit.content_digest(a.orderBy(F.desc("k")).repartition(3), cols).first()
    assert one == two and one["rows"] == 6 and audit.content_digest(b, cols).first().digest != one.digest
    changes = spark.createDataFrame([("s", "c1"), ("s", "c2"), ("t", "c1")], "slice string, cell_id string")
    covers = spark.createDataFrame([("q1", "c1"), ("q1", "c2"), ("q2", "c2")], "query_id string, cell_id string")
    left = audit.unexplained_changes(changes, spark.createDataFrame([("q1",)], "query_id string"), covers, spark.createDataFrame([("s", "q1"), ("t", "q2")], "slice string, query_id string"), ["slice"])
    assert rows(left) == [("t", "c1")]


def test_gate(spark):
    rng = random.Random(2)
    data = [(f"f{i % 3}", float(x), rng.choice("ab"), int(x > 5), 0) for i in range(240) for x in [rng.randrange(10)]]
    train = spark.createDataFrame(data, "fam string, x double, c string, helpful int, harmful int")
    test = spark.createDataFrame([(i, float(i), "unseen" if i == 3 else "a") for i in range(10)], "id int, x double, c string")
    p = gate.UpliftGate(["x"], ["c"], "fam", linear=True).predict(train, test)
    assert p.select("replica").distinct().count() == 4 and p.agg(F.max("p_harmful")).first()[0] == 0.0
    out = {r.id: r for r in gate.gain_and_spread(p, ["id"]).collect()}
    assert all(r.conservative_uplift >= 0 and r.sigma >= 0 for r in out.values()) and out[9].net_gain > 0.7 > 0.3 > out[0].net_gain
    with pytest.raises(ValueError):
        gate.UpliftGate(["clean_value"], [], "fam")
    for name in ("annotation", "baran_correct", "correct_repair", "error_type", "harmful", "helpful", "llm_correct", "llm_correct_in_query", "missing_value", "right_value", "tuple_pairs", "base_correct", " Helpful "):
        with pytest.raises(ValueError, match="right value"):
            gate.UpliftGate(["x"], [name], "fam")
    t = gate.uplift_targets(spark.createDataFrame([(1, 0, True), (0, 1, True), (0, 1, False), (None, 1, True)], "b int, l int, x boolean"), "b", "l", "x")
    assert [(r.helpful, r.harmful) for r in t.collect()] == [(0, 1), (1, 0), (0, 0), (1, 0)]


def test_ranks_with_a_hot_key(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.randrange(40), i) for i in range(600)]
    got = {r.i: (r["rank"], r.members) for r in grouping.ranks(spark, spark.createDataFrame(data, "k string, x int, i int"), ["k"], ["x", "i"]).collect()}
    for k in {k for k, _, _ in data}:
        own = sorted((x, i) for q, x, i in data if q == k)
        assert [got[i] for _, i in own] == [(n + 1, len(own)) for n in range(len(own))]
    assert grouping.ranks(spark, spark.createDataFrame([], "k string, x int"), ["k"], ["x"]).collect() == []
