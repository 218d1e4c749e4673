"""Leaf orders of buckets above the former 2,048: one order, near and equal vectors next to each other."""

import numpy as np
from pyspark.sql import functions as F

from cellmend.operators import grouping, workflow


def test_a_large_bucket_is_one_order(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1200, 16))
    data = [("b", f"k{i:04d}{s}", (v + (s == "y") * 1e-6).tolist()) for i, v in enumerate(base) for s in "xy"]
    parts = grouping.leaf_orders(spark.createDataFrame(data, "b string, k string, v array<double>").repartition(3), ["b"], "k", "v").collect()
    assert len(parts) == 1 and sorted(parts[0].ordered) == sorted(k for _, k, _ in data)
    at = {k: i for i, k in enumerate(parts[0].ordered)}
    assert all(abs(at[f"k{i:04d}x"] - at[f"k{i:04d}y"]) == 1 for i in range(1200))


def test_equal_texts_are_one_leaf(spark):
    items = spark.range(3000).select(F.lit("b").alias("b"), F.format_string("k%04d", "id").alias("k"), (F.col("id") % 3).alias("t"))
    terms = items.select("k", F.concat(F.lit("t"), F.col("t").cast("string")).alias("term"), F.lit(1.0).alias("weight"))
    parts = workflow.sparse_leaf_orders(items.select("b", "k"), ["b"], "k", terms).collect()
    assert len(parts) == 1 and parts[0].ordered == [f"k{i:04d}" for t in range(3) for i in range(t, 3000, 3)]
