"""Hash-to-min against union-find."""

import random

import pytest
from pyspark.sql import functions as F

from cellmend.llm import components
from cellmend.llm.components import conflict_groups, hash_to_min, row_links


def _plain(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for s, a, b in edges:
        if s is not None and a is not None and b is not None and a != b:
            x, y = find((s, a)), find((s, b))
            up[max(x, y)] = min(x, y)
    return sorted((*v, find(v)[1]) for v in up)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty", "tree"])
@pytest.mark.parametrize("rows", [0, 300_000])
def test_shapes(spark, shape, rows, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(components, "HOT_LEAST", 20)  # so that the broadcast of hot vertices is used
    rng = random.Random(3)
    if shape == "chain":
        order = list(range(200))
        rng.shuffle(order)
        edges = [("s", a, b) for a, b in zip(order, order[1:])]
    elif shape == "star":
        edges = [("s", 150, i) for i in range(300)] + [("t", i, i + 1) for i in range(0, 40, 2)]
    elif shape == "random":
        edges = [(rng.choice("st"), rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [("s", 1, 1), (None, 1, 2), ("s", None, 2), ("s", 5, None)] * 2
    elif shape == "tree":
        # subtrees that are put aside in different rounds, with numbers that fall and rise along the branches
        edges = [("s", i * 7919 % 401, (i // 2) * 7919 % 401) for i in range(1, 300)]
    else:
        edges = []
    df = spark.createDataFrame(edges, "space string, a int, b int").withColumn("v", F.lit("clash")).withColumn("u", F.lit(0))
    got = hash_to_min(spark, df, "a", "b", within=("space",))
    assert sorted(map(tuple, got.select("space", "vertex", "component").collect())) == _plain(edges)


def test_notations_and_components(spark):
    texts = ["(1, 2)", "{(3 , 4)}", "('5', '6')", "(7.0, 8.0)", "[[9, 10]]", "11-12", "13:14|14:15", "(20, 21), (22, 23)", "(30,31); (31,32)", "[(40, 41), (42, 43)]", "50-51;52-53", "(60.0, 61.0) (62.0, 63.0)"]
    none = ["", None, "None", "nan", "[]", "()", "(35)", "(172, )", "(, 3182)", "(?, ?)", "[192]", "166", "(70, 70)", "(99999999999, 1)", "(1.5, 2)"]
    log = spark.createDataFrame([("d", t, "x") for t in texts + none] + [(None, "(1, 2)", "x")], "dataset string, tuple_pairs string, rows string")
    fd = spark.createDataFrame([("d", ["s:d:100:1", "s:d:102:4", "broken", None], [101, 100, None, 101]), ("d", None, [200]), ("d", None, None), ("d", [], [300, 301]), ("e", ["s:e:1:0", "s:e:2:0"], None)], "dataset string, cell_ids array<string>, row_indices array<int>")
    pairs = {tuple(sorted((r.a, r.b))) for r in row_links(log, fd).where("dataset = 'd' and a <> b").collect()}
    assert pairs >= {(1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (14, 15), (20, 21), (22, 23), (30, 31), (31, 32), (40, 41), (42, 43), (50, 51), (52, 53), (60, 61), (62, 63), (100, 101), (100, 102), (300, 301)}
    assert len(pairs) == 21
    got = {(r.dataset, r.row_idx): r.group_row for r in conflict_groups(spark, log, fd).collect()}
    assert got["d", 15] == 13 and got["d", 32] == 30 and got["d", 102] == 100 and got["e", 2] == 1
    assert ("d", 70) not in got and ("d", 200) not in got and ("d", 35) not in got
