"""Differences between two copies of a keyed data set, by set reconciliation.

Each copy is reduced to one 60-bit element per key: a hash of the key and of the compared fields of
the key's latest row. Keys are spread over buckets of about `rows_per_bucket`. A bucket's elements
are the roots of its characteristic polynomial over the field of 2**61 - 1, and all that a copy gives
away of a bucket is its row count and the values of that polynomial at a few sample points. The ratio
of the two copies' values is a rational function in which everything common cancels; interpolating it
gives the polynomials of what only one copy has. Two further sample points verify it. A bucket that
does not verify is sketched again with twice the degree bound, until it does: a bound above the number of
its elements always does. Only the rows whose elements are roots are fetched, and their fields compared
as they are. On request (`largest_bound`) buckets that a bound has not verified are listed instead.

Cost: per copy one aggregation over 32 bytes a row, one pass of field arithmetic, and a fetch of the
rows that differ. Copies whose buckets agree never exchange their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.functions import field61 as gf
from cellmend.session import Stages, broadcast_if_small, shuffle_width

CHECKS = 2
_SKETCH = "bucket long, side int, n long, values array<long>"
_FOUND = "bucket long, state string, p array<long>, q array<long>"


def _arrays(flat: np.ndarray, width: int) -> pa.Array:
    offsets = np.arange(0, flat.size + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def _sketcher(side: int, zs: list[int]) -> Callable:
    """Partial products of (z - element) per bucket; the input is sorted by bucket."""
    points = np.array(zs, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            x = batch.column("element").to_numpy()[order].astype(np.uint64)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            sizes = np.diff(np.r_[starts, bucket.size])
            product = np.ones((starts.size, points.size), dtype=np.uint64)
            # the i-th element of every bucket at once, largest buckets first so that the live ones are a prefix
            by_size = np.argsort(-sizes, kind="stable")
            left = starts[by_size]
            live_sizes = sizes[by_size]
            for i in range(int(sizes.max())):
                live = int(np.searchsorted(-live_sizes, -i, side="left"))
                factor = points[None, :] - x[left[:live] + i][:, None]
                product[:live] = gf.mul(product[:live], factor)
            back = np.empty_like(by_size)
            back[by_size] = np.arange(by_size.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts]), pa.array(np.full(starts.size, side, np.int32)), pa.array(sizes.astype(np.int64)), _arrays(product[back].ravel(), points.size)],
                names=["bucket", "side", "n", "values"],
            )

    return run


_basis = lru_cache(8)(lambda zs: gf.basis(list(zs)))


def _reconcile_group(bucket: np.ndarray, side: np.ndarray, n: np.ndarray, values: np.ndarray, zs: list[int], last: bool):
    """Rows (bucket, state, p, q) of the buckets that differ or are unresolved."""
    ids, at = np.unique(bucket, return_inverse=True)
    counts = np.zeros((2, ids.size), dtype=np.int64)
    product = np.ones((2, ids.size, len(zs)), dtype=np.uint64)
    for s in (0, 1):
        rows = np.flatnonzero(side == s)
        np.add.at(counts[s], at[rows], n[rows])
        rank = np.zeros(rows.size, dtype=np.int64)
        order = np.argsort(at[rows], kind="stable")
        sorted_at = at[rows][order]
        first = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]]) if rows.size else np.zeros(0, int)
        rank[order] = np.arange(rows.size) - np.repeat(first, np.diff(np.r_[first, rows.size])) if rows.size else 0
        for r in range(int(rank.max()) + 1 if rows.size else 0):
            take = rows[rank == r]
            product[s, at[take]] = gf.mul(product[s, at[take]], values[take])
    ratio = gf.mul(product[0], gf.inverse(product[1]))
    delta = counts[0] - counts[1]
    differ = np.flatnonzero((delta != 0) | (ratio != 1).any(axis=1))
    m = len(zs) - CHECKS
    matrix, whole = _basis(tuple(zs[:m]))
    coefficients = np.zeros((differ.size, m), dtype=np.uint64)
    for j in range(m):
        coefficients = gf.add(coefficients, gf.mul(ratio[differ, j][:, None], matrix[j][None, :]))
    for row, i in enumerate(differ):
        d = int(delta[i])
        if abs(d) < m:
            p, q = gf.rational([int(c) for c in coefficients[row]], whole, (m - 1 + d) // 2)
            if p and q and p[-1] == 1 and len(p) - len(q) == d and all(
                gf.evaluate(p, z) == int(ratio[i, m + k]) * gf.evaluate(q, z) % gf.P for k, z in enumerate(zs[m:])
            ):
                yield int(ids[i]), "roots", p, q
                continue
        yield int(ids[i]), "list" if last else "again", [], []


def _reconciler(zs: list[int], last: bool) -> Callable:
    """Interpolates each bucket's ratio; the input holds whole buckets, sorted."""

    def out(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (2, 3))],
            names=["bucket", "state", "p", "q"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(parts):
            columns = [np.concatenate(c) for c in zip(*parts)]
            return out(list(_reconcile_group(*columns, zs, last)))

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(-1, len(zs))
            columns = (batch.column("bucket").to_numpy(), batch.column("side").to_numpy(), batch.column("n").to_numpy(), values)
            edge = int(np.searchsorted(columns[0], columns[0][-1], side="left"))  # the last bucket may go on in the next batch
            if edge:
                yield flush([*held, tuple(c[:edge] for c in columns)])
                held = []
            held.append(tuple(c[edge:] for c in columns))
        if held:
            yield flush(held)

    return run


def _root_finder(polynomial: str) -> Callable:
    """Keeps the rows whose element is a root of their bucket's polynomial, or whose bucket is listed whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(polynomial)
            degree = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            starts = np.r_[0, np.cumsum(degree)[:-1]] if degree.size else degree
            x = batch.column("element").to_numpy().astype(np.uint64)
            value = np.zeros(x.size, dtype=np.uint64)
            for i in range(int(degree.max()) - 1 if degree.size else -1, -1, -1):
                live = np.flatnonzero(degree > i)
                value[live] = gf.add(gf.mul(value[live], x[live]), flat[starts[live] + i])
            listed = batch.column("state").to_numpy(zero_copy_only=False) == "list"
            keep = batch.filter(pa.array(listed | ((degree > 1) & (value == 0))))
            yield pa.RecordBatch.from_arrays([keep.column(c) for c in ("k1", "k2", "place", "element")], names=["k1", "k2", "place", "element"])

    return run


def _hash(columns: list[Column], salt: int) -> Column:
    """A null and the text of no null hash apart, and neighbouring texts don't run together."""
    return F.xxhash64(F.lit(salt), *(x for c in columns for x in (c.isNull(), c)))


class SetReconciliation:
    """Compares two copies.

    keys, fields: expressions by name, the same for both copies (give each copy its own where they are
    written differently). order: the column that tells a key's latest row. Two keys are one where all
    key expressions are equal, null being equal to null; fields are compared in the same way. Of rows of
    one key with the same place in the order, the one with the largest element counts, so repeated rows
    do no harm. An empty copy makes every key of the other one missing.
    """

    def __init__(self, spark: SparkSession, rows_per_bucket: int = 64, degree_bound: int = 16, largest_bound: int | None = None):
        self.spark, self.rows_per_bucket, self.degree_bound, self.largest_bound = spark, rows_per_bucket, degree_bound, largest_bound

    def _prepared(self, df: DataFrame, keys: dict[str, Column], fields: dict[str, Column], order: str) -> DataFrame:
        named = df.select(*(e.alias(f"_k_{k}") for k, e in keys.items()), *(e.alias(f"_f_{k}") for k, e in fields.items()), F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63))).alias("place"))
        key, field = [F.col(f"_k_{k}") for k in keys], [F.col(f"_f_{k}") for k in fields]
        named = named.withColumns({"k1": _hash(key, 1), "k2": _hash(key, 2)})
        return named.withColumn("element", _hash([F.col("k1"), F.col("k2"), *field], 3).bitwiseAND(F.lit((1 << 60) - 1)))

    def differing(self, first: DataFrame, second: DataFrame, keys, fields, order: str) -> tuple[DataFrame, DataFrame]:
        """The latest rows (_k_ and _f_ columns) of the keys that differ or are missing, of each copy.

        keys and fields: a pair of dicts of expressions, one for each copy.
        """
        stages = Stages(self.spark, "reconcile")
        prepared = [self._prepared(df, k, f, order) for df, k, f in zip((first, second), keys, fields)]
        width = shuffle_width(self.spark)
        rows = max(first.count(), second.count())
        # a multiple of the shuffle width, so that the aggregation below already leaves each bucket in one partition
        buckets = min(1 << 30, max(1, -(-rows // (self.rows_per_bucket * width)))) * width
        latest = []
        for df in prepared:
            by_key = df.groupBy("k1", "k2").agg(F.max(F.struct("place", "element")).alias("top"))
            by_key = by_key.select(F.pmod(F.hash("k1", "k2"), F.lit(buckets)).cast("long").alias("bucket"), "k1", "k2", "top.*")
            latest.append(stages.keep(by_key.sortWithinPartitions("bucket")))

        m, todo, found = self.degree_bound, None, []
        while True:
            last = self.largest_bound is not None and 2 * m > self.largest_bound
            zs = gf.points(m + CHECKS)
            sketches = [(df if todo is None else df.join(todo, "bucket", "left_semi")).select("bucket", "element").mapInArrow(_sketcher(s, zs), _SKETCH) for s, df in enumerate(latest)]
            whole = sketches[0].unionByName(sketches[1]).repartition(width, "bucket").sortWithinPartitions("bucket")
            result, path = stages.write(whole.mapInArrow(_reconciler(zs, last), _FOUND))
            found.append(result.where("state <> 'again'"))
            todo = result.where("state = 'again'").select("bucket")
            if last or todo.isEmpty():
                break
            m *= 2
        polynomials = reduce(DataFrame.unionByName, found)

        sides = []
        for df, whole, p in zip(latest, prepared, "pq"):
            wanted = df.join(polynomials.select("bucket", "state", p), "bucket").mapInArrow(_root_finder(p), "k1 long, k2 long, place long, element long")
            wanted = broadcast_if_small(stages.keep(wanted))
            sides.append(whole.join(wanted, ["k1", "k2", "place", "element"], "left_semi").dropDuplicates(["k1", "k2"]).drop("place", "element"))
        return sides[0], sides[1]

    def compare(self, first: DataFrame, second: DataFrame, keys, fields, order: str) -> DataFrame:
        """One row per key held by one copy only and per field that differs: key columns and `difference`."""
        names, compared = list(keys[0]), list(fields[0])
        a, b = self.differing(first, second, keys, fields, order)
        side = lambda df, s: df.select("k1", "k2", F.lit(True).alias(f"{s}_here"), *(F.col(f"_k_{k}").alias(f"{s}_k_{k}") for k in names), *(F.col(f"_f_{k}").alias(f"{s}_f_{k}") for k in compared))
        both = side(a, "a").join(side(b, "b"), ["k1", "k2"], "full_outer")
        kinds = F.when(F.col("a_here").isNull(), F.array(F.lit("missing_first"))).when(F.col("b_here").isNull(), F.array(F.lit("missing_second"))).otherwise(
            F.filter(F.array(*(F.when(~F.col(f"a_f_{k}").eqNullSafe(F.col(f"b_f_{k}")), F.lit(k)) for k in compared)), lambda x: x.isNotNull())
        )
        pick = lambda k: F.when(F.col("a_here").isNotNull(), F.col(f"a_k_{k}")).otherwise(F.col(f"b_k_{k}")).alias(k)
        return both.select(*(pick(k) for k in names), F.explode(kinds).alias("difference"))
