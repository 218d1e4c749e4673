"""The gate leaves out each family, however many there are, and fits what Spark's own head would fit."""

import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cellmend.operators import gate


def _spark_head(train, test, label):
    steps = [Imputer(strategy="median", inputCols=["x"], outputCols=["xi"]), StringIndexer(inputCol="c", outputCol="ci", handleInvalid="keep"), VectorAssembler(inputCols=["xi", "ci"], outputCol="v"), LogisticRegression(featuresCol="v", labelCol=label, regParam=0.01, maxIter=100, tol=1e-10)]
    return {r.id: r.p for r in Pipeline(stages=steps).fit(train).transform(test).select("id", vector_to_array("probability")[1].alias("p")).collect()}


def test_every_family_is_left_out(spark):
    rng = random.Random(5)
    data = []
    for i in range(900):
        x = rng.gauss(0, 3)
        data.append((None if i % 9 == 0 else f"f{i % 70:02d}", None if i % 11 == 0 else x, rng.choice("aabc"), int(x + rng.gauss(0, 2) > 1), int(x + rng.gauss(0, 2) < -2)))
    train = spark.createDataFrame(data, "fam string, x double, c string, helpful int, harmful int")
    test = spark.createDataFrame([(i, float(i - 5), "new" if i == 3 else "abc"[i % 3]) for i in range(10)], "id int, x double, c string")
    got = {(r.replica, r.id): (r.p_helpful, r.p_harmful) for r in gate.UpliftGate(["x"], ["c"], "fam", linear=True).predict(train, test).collect()}
    assert {r for r, _ in got} == {"full", *(f"f{i:02d}" for i in range(70))} and len(got) == 710
    for name in ("full", "f07", "f42"):
        rows = train if name == "full" else gate.training_rows(train, "fam", name)
        for h, label in enumerate(("helpful", "harmful")):
            want = _spark_head(rows.withColumn(label, F.col(label).cast("double")), test, label)
            assert all(abs(got[name, i][h] - p) < 2e-3 for i, p in want.items())


def test_query_leaves_out_base_families(spark, tmp_path):
    from cellmend.plans import workflow

    rng = random.Random(6)
    names = [" Depot", "depot", "CLINIC", "n/a", "Unknown", "", None, "orchard"]
    e = [("s", f"c{i}", rng.choice(names), "k" + rng.choice("ab"), str(rng.random()), rng.randrange(2), rng.randrange(2), "completed", rng.randrange(900)) for i in range(300)]
    spark.createDataFrame(e, "suite string, cell_id string, base_family string, column_name string, dirty_value string, baran_correct int, llm_correct int, llm_status string, llm_observed_total_tokens long").write.parquet(f"{tmp_path}/evidence_cells.parquet")
    out = workflow.uplift_gate(spark, str(tmp_path))
    # one suite gives no replica and no spread, three families do
    assert out.count() == 300 and out.agg(F.min("sigma")).first()[0] > 0
