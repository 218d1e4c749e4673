"""SQL functions, table functions, reports and the command line."""

from pyspark.sql import functions as F

from cellmend import cli
from cellmend.functions import scalars as S
from cellmend.functions import sql
from cellmend.operators.deliveries import canonical_digest
from cellmend.sources import reports

VALUES = [None, "", " \t\n", "a&amp;lt;b", "x \n\t y", "3.5", "1,2", "2020-01-02", "3:05 P.M.", "a@b.c", "www.x.y", "YES", "Ab-12  cd", "é²x", "x" * 200, "日本 abc", " SHA256:AB ", "0xFF"]


def test_functions_in_sql_are_those_of_the_library(spark):
    names = sql.register(spark)
    assert {"normalize_value", "value_type", "half_stride_windows", "parse_repairs", "salvage_json"} <= set(names)
    spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string").createOrReplaceTempView("some_values")
    got = spark.sql("SELECT i, n, value_type(n) t, format_signature(n) f, bounded_text(n, 160) b, token_estimate(n) k, canonical_digest(v) d FROM (SELECT i, v, normalize_value(v) n FROM some_values)")
    n = S.normalize_value(F.col("v"))
    want = spark.table("some_values").select("i", n.alias("n"), S.value_type(n).alias("t"), S.format_signature(n).alias("f"), S.bounded(n).alias("b"), S.token_estimate(n).alias("k"), canonical_digest(F.col("v")).alias("d"))
    assert sorted(got.collect()) == sorted(want.collect())
    x = F.col("x")
    numbers = spark.createDataFrame([(v,) for v in (0.0, 0.1, -0.5, 1.0, 7.0, 1e9)], "x double")
    numbers.createOrReplaceTempView("some_numbers")
    assert spark.sql("SELECT x, support_bucket(x) b FROM some_numbers").collect() == numbers.select("x", S.support_bucket(x).alias("b")).collect()
    assert [tuple(r) for r in spark.sql("SELECT * FROM half_stride_windows(array('a','b','c','d','e'), 4)").collect()] == [(0, list("abcd")), (1, list("bcde"))]
    assert spark.sql("SELECT * FROM half_stride_windows(array('a'), 4)").collect() == []
    answer = 'so {"query_id": "q", "repairs": [{"cell_id": "c", "repair": "v", "confidence": "0.5", "decision": "Propose", "evidence": ""}]} done'
    r = spark.sql("SELECT * FROM parse_repairs(:t, 'q', array('c'))", args={"t": answer}).first()
    assert (r.cell_id, r.repair, r.confidence, r.decision, r.parse_status) == ("c", "v", 0.5, "propose", "ok")
    assert spark.sql("SELECT parse_status FROM parse_repairs('none', 'q', array('c'))").first()[0] == "no_json_object"
    assert spark.sql("SELECT salvage_json('a {\"b\": 1} c')").first()[0] == '{"b": 1}'


def test_reports_and_configuration(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.0, None), ("<c>", float("nan"), 2)], "s string, x double, n int")
    assert reports.markdown(df).splitlines()[2] == "| a\\|b | 1 |  |"
    assert "&lt;c&gt;" in reports.html_table(df, "t") and reports.json_rows(df).splitlines()[1] == '{"n": 2, "s": "<c>", "x": null}'
    assert reports.svg_lines(df.where("n > 5"), "s", "x", "n").startswith("<svg") and "polyline" in reports.svg_lines(df.fillna(0), "s", "x", "n")
    assert reports.redacted({"a": [{"API_key": "k"}], "b": 1}) == {"a": [{"API_key": "<redacted>"}], "b": 1}
    (tmp_path / ".env").write_text("# c\nexport A='x y'\nB = 2\n\nbroken\n")
    assert reports.read_env(str(tmp_path / ".env")) == {"A": "x y", "B": "2"}


def test_command_line(spark, tmp_path, capsys):
    queries = cli.all_queries()
    assert all(q in queries for _, names in cli.VERBS.values() for q in names)
    assert cli.main(["list"]) == 0 and "p1_found" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "--data", "x"]) == 2
    spark.createDataFrame([(1, "a", None)], "delivery_id long, x string, y string").write.parquet(str(tmp_path / "group_checkpoint.parquet"))
    assert cli.main(["run", "delivery_contract", "--data", str(tmp_path), "--out", str(tmp_path / "out")]) == 0
    assert "| 1 | 1 | 0 | True |" in (tmp_path / "out" / "delivery_contract.md").read_text()
