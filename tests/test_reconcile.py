"""Set reconciliation against a plain comparison."""

import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from cellmend.functions import field61 as gf
from cellmend.operators.reconcile import SetReconciliation
from cellmend.plans.general import ledger_differences

SCHEMA = "row_index long, method_name string, backend string, budget_share double, cell_id string, prediction string, correct_repair {}, parse_status string"


def test_field_arithmetic_equals_whole_numbers():
    rng = random.Random(1)
    a = [rng.randrange(gf.P) for _ in range(500)] + [0, 1, gf.P - 1]
    b = [rng.randrange(gf.P) for _ in range(500)] + [gf.P - 1, gf.P - 1, gf.P - 1]
    x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
    assert gf.mul(x, y).tolist() == [p * q % gf.P for p, q in zip(a, b)]
    assert gf.add(x, y).tolist() == [(p + q) % gf.P for p, q in zip(a, b)]
    assert gf.sub(x, y).tolist() == [(p - q) % gf.P for p, q in zip(a, b)]
    assert gf.mul(x[:500], gf.inverse(x[:500])).tolist() == [1] * 500


def test_rational_function_is_recovered():
    rng = random.Random(2)
    common, own, other = ([rng.randrange(1 << 60) for _ in range(n)] for n in (40, 5, 3))
    zs = gf.points(16)
    value = lambda roots, z: np.prod([1]) and __import__("functools").reduce(lambda p, r: p * (z - r) % gf.P, roots, 1)
    ratio = [value(common + own, z) * pow(value(common + other, z), gf.P - 2, gf.P) % gf.P for z in zs]
    matrix, whole = gf.basis(zs)
    coefficients = [sum(r * int(m) for r, m in zip(ratio, matrix[:, k])) % gf.P for k in range(16)]
    p, q = gf.rational(coefficients, whole, (15 + 2) // 2)
    assert len(p) == 6 and len(q) == 4 and all(gf.evaluate(p, r) == 0 for r in own) and all(gf.evaluate(q, r) == 0 for r in other)


def _copies(n, seed, change):
    rng = random.Random(seed)
    first, second = [], []
    for i in range(n):
        key = ("m", "b" if i % 3 else None, [None, 0.1, 0.2][i % 3], f"s:d:{i}:1")
        row = [key[0], key[1], key[2], key[3], rng.choice(["a &amp; b", "x\ty", None, "", "v" * 50]), rng.choice([True, False, None]), rng.choice(["ok", None, "failed"])]
        other = [*row]
        other[2] = None if row[2] is None else row[2] + 1e-13
        other[4] = {"a &amp; b": "a & b", "x\ty": " x y "}.get(row[4], row[4])
        other[5] = None if row[5] is None else ("Yes" if row[5] else "nope")
        kind = rng.random()
        if kind > change / 4:
            first.append(row)
        if change / 4 < kind < change:
            spot = rng.choice([4, 5, 6])
            other[spot] = {4: "changed", 5: "1" if row[5] is not True else "0", 6: "new"}[spot]
        if not change < kind < change * 1.25:
            second.append(other)
        if i % 17 == 0:
            second.insert(0, [*other[:4], "outdated", "no", "old"])
    return [(i, *r) for i, r in enumerate(first)], [(i, *r) for i, r in enumerate(second)]


def _plain(first, second):
    import html
    import re

    def last(rows, text):
        out = {}
        for _, m, b, s, c, p, v, st in sorted(rows):
            p = re.sub("[\t\n ]+", " ", html.unescape(p or "")).strip("\t\n ")
            v = v.lower() in ("1", "true", "yes", "y") if text and v is not None else v
            out[m, b, -1 if s is None else round(s * 100), c] = (p, v, st)
        return out

    a, b = last(first, False), last(second, True)
    out = [(*k, "missing_second") for k in a if k not in b] + [(*k, "missing_first") for k in b if k not in a]
    return sorted(out + [(*k, n) for k in a if k in b for n, x, y in zip(("prediction", "correct_repair", "parse_status"), a[k], b[k]) if x != y], key=repr)


def _run(spark, first, second, **options):
    a = spark.createDataFrame(first, SCHEMA.format("boolean")).withColumn("written_at", F.lit(datetime(2024, 1, 1)))
    b = spark.createDataFrame(second, SCHEMA.format("string")).withColumn("bucket", F.lit("clash")).withColumn("k1", F.lit(1))
    return sorted((tuple(r) for r in ledger_differences(spark, a, b, **options).collect()), key=repr)


def test_few_differences(spark):
    first, second = _copies(1500, 3, 0.04)
    assert _run(spark, first, second) == _plain(first, second)


def test_many_differences_double_the_bound_and_list(spark):
    first, second = _copies(600, 4, 0.6)
    assert _run(spark, first, second, degree_bound=4, largest_bound=32) == _plain(first, second)
    # without a largest bound every bucket goes on until its polynomials verify, up to all of its rows
    assert _run(spark, first, second, degree_bound=4) == _plain(first, second)
    assert _run(spark, first, [], degree_bound=4, rows_per_bucket=40) == _plain(first, [])


def test_empty_copies_and_repeated_rows(spark):
    first, second = _copies(60, 5, 0.2)
    assert _run(spark, first, []) == _plain(first, [])
    assert _run(spark, [], []) == []
    assert _run(spark, first + first, second + second) == _plain(first, second)


def test_other_keys_and_fields(spark):
    a = spark.createDataFrame([(1, 0, "x"), (2, 1, None), (None, 2, "n")], "id int, at long, v string")
    b = spark.createDataFrame([(1, 5, "y"), (2, 6, None), (3, 7, "z")], "id int, at long, v string")
    e = ({"id": F.col("id")}, {"v": F.col("v")})
    found = SetReconciliation(spark).compare(a, b, (e[0], e[0]), (e[1], e[1]), "at")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "v"), (3, "missing_first"), (None, "missing_second")], key=repr)
