"""Prompts of many queries: actions are read once, and prompts keep what they hold."""

from pyspark.sql import functions as F

from cellmend.functions.scalars import token_estimate
from cellmend.operators import prompts


def test_actions_are_read_once(spark):
    actions = spark.createDataFrame([("q1", "d", ["b", "a"]), ("q2", "d", ["a"])], "query_id string, dataset string, cell_ids array<string>")
    cells = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "cell_id string, column_name string, dirty_value string")
    masked = spark.createDataFrame([("a", "x=? | y=2"), ("b", "x=1 | y=?")], "cell_id string, masked string")
    x = prompts.with_prompts(actions, cells, masked)
    got = {r.query_id: r for r in x.collect()}
    a, b = '{"cell_id":"a","column":"x","dirty_value":"1","row":"x=? | y=2"}', '{"cell_id":"b","column":"y","dirty_value":"2","row":"x=1 | y=?"}'
    assert got["q1"].payload == f'{{"cells":[{a},{b}],"dataset":"d","query_id":"q1"}}' and got["q2"].payload == f'{{"cells":[{a}],"dataset":"d","query_id":"q2"}}'
    assert (got["q1"].completion_ceiling, got["q2"].completion_ceiling) == (448, 192) and got["q1"].prompt_hash != got["q2"].prompt_hash
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [query_id") == 1


def test_tokens_of_ascii_and_other_texts(spark):
    texts = ["", "a", "abcde", "é", "ab日本", "日本語"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", token_estimate(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 3, 5: 3}
