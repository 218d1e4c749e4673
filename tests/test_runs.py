"""Contracts that refuse, clients that are asked again, streams that drift, and the stages of a run."""

import pytest
from pyspark.sql import functions as F

from cellmend.functions import scalars as S  # noqa: F401
from cellmend.operators import contracts, replay
from cellmend.runs import BindingDrift, Run, fingerprint
from cellmend.sources import files
from cellmend.streaming.ledger import ingest


def test_numbers(spark):
    values = ["3", "3.0", " -7 ", "3.5", "true", "", None, "12345678901234567890123", "1e3"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(contracts.exact_integer(F.col("v"))).collect()]
    assert [None if x is None else int(x) for x in got] == [3, 3, -7, None, None, None, None, 12345678901234567890123, None]
    doubles = [1.5, -1.0, float("nan"), float("inf"), None, 0.0]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in doubles], "v double").select(contracts.non_negative(F.col("v"))).collect()] == [1.5, 0, 0, 0, 0, 0]


def test_joins_sizes_and_exclusions_that_refuse(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 3), ("y", 4)], "k string, w int")
    assert contracts.one_to_one(a, b, ["k"]).count() == 2
    for wrong in (b.unionByName(b.limit(1)), b.limit(1)):
        with pytest.raises(ValueError, match="one to one"):
            contracts.one_to_one(a, wrong, ["k"])
    actions = spark.createDataFrame([("q", 1), ("r", 4)], "query_id string, size int")
    assert contracts.of_sizes(actions, [1, 4]).count() == 2
    with pytest.raises(ValueError, match="size"):
        contracts.of_sizes(actions, [1, 2])
    assert contracts.without_datasets(a, a.where("k = 'x'"), ["k"]).collect()[0].k == "y"
    with pytest.raises(ValueError, match="isn't there"):
        contracts.without_datasets(a, spark.createDataFrame([("z",)], "k string"), ["k"])
    assert contracts.union_of_columns([a, b]).columns == ["k", "v", "w"]


def test_partitions(spark):
    rows = [("c", 0, 0, "a"), ("c", 0, 1, "b"), ("c", 1, 0, "d"), ("c", 1, 1, "e")]
    schema = "cond string, block int, member_index int, cell_id string"
    structured = spark.createDataFrame(rows, schema)
    swapped = spark.createDataFrame([("c", 0, 0, "a"), ("c", 1, 1, "b"), ("c", 1, 0, "d"), ("c", 0, 1, "e")], schema)
    assert contracts.partition_mismatches(structured, swapped, ["cond"]).collect() == []
    assert {r.reason for r in contracts.partition_mismatches(structured, structured, ["cond"]).collect()} == {"equal_block"}
    moved = spark.createDataFrame([("c", 0, 1, "a"), ("c", 1, 1, "b"), ("c", 1, 0, "d"), ("c", 0, 0, "e")], schema)
    assert {r.reason for r in contracts.partition_mismatches(structured, moved, ["cond"]).collect()} == {"place"}


def test_selections_and_savings(spark):
    s = spark.createDataFrame([("d", "q1", ["a", "b"], 10), ("d", "q2", ["a"], 8), ("d", "q3", ["b"], 6)], "d string, query_id string, cell_ids array<string>, query_cost long").withColumn("size", F.size("cell_ids"))
    got = {r.query_id: r.saving_ratio for r in contracts.group_savings(s).collect()}
    assert got["q1"] == pytest.approx(1 - 10 / 14) and got["q2"] == 0
    assert contracts.group_savings(s.where("query_id <> 'q3'")).where("query_id = 'q1'").first().saving_ratio is None
    scored = spark.createDataFrame([("d", "q1", "a"), ("d", "q1", "z")], "d string, query_id string, cell_id string")
    assert sorted((r.cell_id, r.state) for r in contracts.selection_coverage(s.where("query_id = 'q1'"), scored, ["d"]).collect()) == [("b", "missing"), ("z", "extra")]
    old = spark.createDataFrame([("d", 1, "q1"), ("d", 2, "q2"), ("e", 1, "q")], "s string, i int, query_id string")
    new = spark.createDataFrame([("d", 1, "q2"), ("d", 2, "q1")], "s string, i int, query_id string")
    assert {r.s: r.equal for r in replay.same_order(old, new, ["s"], "i").collect()} == {"d": False, "e": False} and {r.equal for r in replay.same_order(old, old, ["s"], "i").collect()} == {True}


def test_caps_and_validation(spark):
    assert replay.token_cap(None, 5) == 5 and replay.token_cap(7, 5) == 7 and replay.token_cap(None, None, True) is None
    for wrong in ((None, None), (0, None)):
        with pytest.raises(ValueError):
            replay.token_cap(*wrong)
    assert replay.reserve(10, 5, 40, 6) == 40
    with pytest.raises(replay.TokenCapExceeded):
        replay.reserve(10, 6, 40, 6)
    t = spark.range(3).selectExpr("id", "cast(id as string) v")
    bound = replay.bindings({"t": t, "u": t.where("id < 2")})
    assert replay.binding_drift(bound, replay.bindings({"t": t.repartition(3), "u": t.where("id < 2")})).collect() == []
    changed = replay.bindings({"t": t.withColumn("v", F.lit("x")), "w": t})
    assert {r["name"]: r.state for r in replay.binding_drift(bound, changed).collect()} == {"t": "content", "u": "missing", "w": "extra"}
    assert {r.check: r.ok for r in replay.validation({"a": t.where("false"), "b": t}).collect()} == {"a": True, "b": False}
    assert {r["name"]: r.ok for r in replay.acceptance(spark.createDataFrame([("f1", 9)], "name string, rows int"), {"f1": 9, "aubc": 22}).collect()} == {"f1": True, "aubc": False}
    again = spark.createDataFrame([(1, "q", "none", ["c"], "ok")], "delivery_id long, query_id string, response_text string, cell_ids array<string>, parse_status string")
    assert replay.parse_drift(again).first().parsed_status == "no_json_object"


def test_asked_again_and_taken_up(spark, tmp_path):
    requests = spark.createDataFrame([(i, 10) for i in range(30)], "id int, tokens int")
    ledger, seen = str(tmp_path / "ledger"), str(tmp_path / "seen")

    def fetch(rows):
        import os

        os.makedirs(seen, exist_ok=True)
        out = []
        for r in rows:
            with open(f"{seen}/{r['id']}", "a") as f:
                f.write("x")
            tries = os.path.getsize(f"{seen}/{r['id']}")
            out.append({"id": r["id"], "status": "failed" if r["id"] == 7 or (r["id"] % 5 == 0 and tries < 3) else "success", "model_returned": "m"})
        return out

    ask = lambda **more: files.ask_until_answered(requests, ledger, "id int, status string, model_returned string", fetch, ["id"], attempts=3, concurrency=2, chunk=8, backoff=0.0, **more)
    with pytest.raises(replay.TokenCapExceeded):
        ask(planned="tokens", cap=899)
    got = {r.id: (r.status, r.attempts) for r in ask(planned="tokens", cap=900).collect()}
    assert len(got) == 30 and got[7] == ("failed", 3) and got[5] == ("success", 3) and got[1] == ("success", 1)
    assert ask().count() == 31  # only the failure is asked again
    with pytest.raises(Exception, match="isn't other's"):
        files.ask_until_answered(requests, str(tmp_path / "l2"), "id int, status string, model_returned string", fetch, ["id"], backoff=0.0, attempts=1, model="other")


def test_streams_that_drift_or_cost_too_much(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "k string, i int, p string, t int"
    run = lambda name, **more: ingest(spark, src, spark.createDataFrame([], schema).schema, str(tmp_path / name), str(tmp_path / f"{name}-state"), ["k"], "i", files=1, **more)
    for part in ([("a", 1, "x", 5), ("b", 2, "x", 5)], [("a", 3, "x", 5), ("c", 4, "y", 5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    run("ok", identity=["p"], tokens="t", cap=15).awaitTermination()
    assert sorted((r.k, r.i) for r in spark.read.parquet(str(tmp_path / "ok")).select("k", "i").collect()) == [("a", 1), ("b", 2), ("c", 4)]
    with pytest.raises(Exception, match="tokens at worst"):
        run("dear", tokens="t", cap=14).awaitTermination()
    spark.createDataFrame([("a", 5, "other", 5)], schema).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="another identity"):
        run("drift", identity=["p"]).awaitTermination()


def test_stages_of_a_run(spark, tmp_path):
    config, calls = {"a": 1, "api_key": "s"}, []
    run = Run(spark, str(tmp_path), config)
    with pytest.raises(RuntimeError, match="comes after"):
        run.stage("two", dict, ("one",))
    assert run.stage("one", lambda: calls.append(1) or {"rows": 3, "secret": "x"}) == {"rows": 3, "secret": "<redacted>"}
    with pytest.raises(ZeroDivisionError):
        run.stage("two", lambda: 1 / 0, ("one",))
    again = Run(spark, str(tmp_path), {"api_key": "s", "a": 1})
    assert again.completed("one") and again.state["stages"]["two"]["status"] == "failed"
    again.stage("one", lambda: calls.append(2))
    assert calls == [1] and '"s"' not in (tmp_path / "run.json").read_text()
    with pytest.raises(BindingDrift):
        Run(spark, str(tmp_path), {"a": 2, "api_key": "s"})
    assert fingerprint({"a": 1, "b": [2]}) == fingerprint({"b": [2], "a": 1})
