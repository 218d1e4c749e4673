"""Files, manifests, rules, streams and clients."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cellmend.sources import files
from cellmend.streaming.ledger import first_seen, ingest


def test_csv_and_positions(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('﻿row_id,name,n\n1,"a, ""b""",NA\n2, x  y ,\n3,&lt;,1.0\n', encoding="utf-8")
    got = files.read_csv(spark, str(p)).orderBy("row_idx").collect()
    assert [tuple(r) for r in got] == [("1", 'a, "b"', "NA", 0), ("2", "x y", "", 1), ("3", "<", "1.0", 2)]
    many = files.with_positions(spark.range(100).repartition(7), "at").collect()
    assert sorted(r["at"] for r in many) == list(range(100))


def test_json_lines(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n[1]\n{bad\n')
    assert [tuple(r) for r in files.read_json_lines(spark, str(p), "a int, b string", strict=False).collect()] == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="not an object"):
        files.read_json_lines(spark, str(p), "a int, b string").collect()
    out = str(tmp_path / "out")
    files.write_json_lines(spark.range(3), out)
    files.write_json_lines(spark.createDataFrame([(1, "y")], "b int, a string"), out)
    assert json.loads(spark.read.text(out).first()[0]) == {"a": "y", "b": 1}
    ledger = str(tmp_path / "ledger")
    for b in ("b1", "b2"):
        files.append_ledger(spark.range(3).coalesce(1), ledger, b)
    assert sorted((r.batch_id, r.row_index) for r in spark.read.parquet(ledger).collect()) == [(b, i) for b, low in (("b1", 0), ("b2", 3)) for i in range(low, low + 3)]


def test_manifest_and_rules(spark, tmp_path):
    (tmp_path / "f" / "g").mkdir(parents=True)
    (tmp_path / "f" / "a").write_bytes(b"one")
    (tmp_path / "f" / "g" / "b").write_bytes(b"two")
    (tmp_path / "f" / "g" / "empty").write_bytes(b"")
    m = files.manifest(spark, str(tmp_path / "f")).collect()
    before = spark.createDataFrame(m)
    assert {r.path.rpartition("/")[2]: (r.bytes, r.sha256[:8]) for r in m}["empty"] == (0, "e3b0c442") and len(m) == 3
    (tmp_path / "f" / "a").write_bytes(b"eno")
    (tmp_path / "f" / "g" / "b").unlink()
    (tmp_path / "f" / "c").write_bytes(b"new")
    got = {r.path[-1]: r.state for r in files.manifest_differences(before, files.manifest(spark, str(tmp_path / "f"))).collect()}
    assert got == {"a": "content", "b": "missing", "c": "extra"}
    ok = spark.createDataFrame([("a/b",), ("/a",), ("../a",), ("C:\\a",)], "p string").select(files.is_portable(F.col("p"))).collect()
    assert [r[0] for r in ok] == [True, False, False, False]
    r = tmp_path / "r.json"
    r.write_text(json.dumps({"d": [{"rule_id": "r1", "determinant": ["a", "b"], "dependent": "c"}, {"determinant": "a", "dependent": "c"}]}))
    assert [(x.rule_id, x.determinant, x.dependent) for x in files.read_rules(spark, str(r)).collect()] == [("r1", ["a", "b"], "c"), ("d_fd2", ["a"], "c")]
    r.write_text(json.dumps({"d": [{"rule_id": "r1", "determinant": ["c"], "dependent": "c"}]}))
    with pytest.raises(Exception, match="not a rule"):
        files.read_rules(spark, str(r)).collect()


def test_client_and_stream(spark, tmp_path):
    asked = spark.createDataFrame([(i,) for i in range(25)], "id int")
    got = files.ask(asked, "id int, answer string", lambda rows: [{"id": r["id"], "answer": f"a{r['id']}"} for r in rows], 2, 10)
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, f"a{i}") for i in range(25))
    src = str(tmp_path / "in")
    for part in ([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)]):
        spark.createDataFrame(part, "k string, i int").coalesce(1).write.mode("append").parquet(src)
        ingest(spark, src, spark.read.parquet(src).schema, str(tmp_path / "ledger"), str(tmp_path / "state"), ["k"], "i").awaitTermination()
    assert sorted((r.k, r.i) for r in spark.read.parquet(str(tmp_path / "ledger")).select("k", "i").collect()) == [("a", 1), ("b", 2), ("c", 5)]
    events = spark.createDataFrame([("k", datetime(2024, 1, 1)), ("k", datetime(2024, 1, 1, 0, 5)), ("m", datetime(2024, 1, 1))], "k string, at timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    q = first_seen(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), ["k"], "at", "1 hour").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2


def test_stages(spark):
    from cellmend.session import Stages, clear_stages

    stages = Stages(spark, "test")
    one, path = stages.write(spark.range(5))
    assert one.count() == 5 and path.startswith(stages.base)
    clear_stages(spark)
    with pytest.raises(Exception, match="(?i)path|exist|found"):
        spark.read.parquet(path).count()
