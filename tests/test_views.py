"""Group queries of both tables in every configured view, on the smallest test tables."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellmend.operators import workflow

DATA = Path("/root/testdata/sf0.001")


def test_products_of_many_terms():
    rng = np.random.default_rng(2)
    sets = [[{"term": f"t{j}", "weight": float(w)} for j, w in zip(rng.choice(9000, 900, replace=False), rng.random(900))] for _ in range(30)] + [None]
    x, maps = workflow.dense_vectors(pd.Series(sets)), [{t["term"]: t["weight"] for t in v or []} for v in sets]
    want = [[sum(w * b.get(t, 0) for t, w in a.items()) for b in maps] for a in maps]
    assert x.shape[1] <= 31 and np.allclose(x @ x.T, want, atol=1e-9) and not x[-1].any()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_all_views_of_both_tables(spark):
    from cellmend.plans import overlays, workflow as plans

    actions, found, _ = plans._view_actions(spark, str(DATA))
    actions = actions.persist()
    seen = {(r.dataset, r["view"]) for r in actions.select("dataset", "view").distinct().collect()}
    assert {("part", v) for v in ("singleton", "row", "pattern", "public_fd", "semantic")} <= seen
    assert {("customer", v) for v in ("singleton", "pattern", "semantic")} <= seen
    alone = {r.c for r in actions.where("size = 1").select(F.explode("cell_ids").alias("c")).collect()}
    assert alone == {r.cell_id for r in overlays.found(spark, str(DATA)).collect()}
    asked = plans.prompt_requests(spark, str(DATA)).collect()
    assert {r.query_id for r in asked} == {r.query_id for r in actions.select("query_id").collect()} and not any(r.leaks for r in asked)
