"""Checks that hold ledgers against each other: identities, coverage, digests, causes, overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_identities(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def more_than_one(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose columns have more than one distinct value, with the number of each."""
    out = df.groupBy(*keys).agg(*(F.countDistinct(c).alias(f"n_{c}") for c in columns))
    return out.where(" or ".join(f"n_{c} > 1" for c in columns))


def coverage(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, as `missing` (not in actual) or `extra`."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    missing = e.join(a, keys, "left_anti").select(*keys, F.lit("missing").alias("state"))
    return missing.unionByName(a.join(e, keys, "left_anti").select(*keys, F.lit("extra").alias("state")))


def field_differences(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per shared key and field whose values differ, null being equal to null."""
    pick = lambda df, s: df.select(*keys, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(s))
    both = pick(a, "x").join(pick(b, "y"), keys)
    named = [F.struct(F.lit(f).alias("field"), F.col("x")[f].alias("before"), F.col("y")[f].alias("after")) for f in fields]
    return both.select(*keys, F.inline(F.filter(F.array(*named), lambda s: ~s["before"].eqNullSafe(s["after"]))))


def difference_counters(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], by: list[str]) -> DataFrame:
    """Per group: matched, only in one, and changed rows by field."""
    side = lambda df, s: df.select(*keys, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(s))
    both = side(a, "x").join(side(b, "y"), keys, "full_outer")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    x, y = F.col("x").isNotNull(), F.col("y").isNotNull()
    return both.groupBy(*by).agg(one(x & y).alias("matched"), one(x & ~y).alias("only_first"), one(~x & y).alias("only_second"), *(one(x & y & ~F.col("x")[f].eqNullSafe(F.col("y")[f])).alias(f"{f}_changed") for f in fields))


def group_counters(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], right: str, by: list[str]) -> DataFrame:
    """As difference_counters, but null keys are equal; with rows of each side, rows with any change, and rows that became right or wrong.

    Keys are unique on each side. Both sides meet in one aggregation.
    """
    row = F.struct(*(F.col(f).cast("string").alias(f) for f in fields), F.coalesce(F.col(right), F.lit(False)).alias("_right"))
    none = F.lit(None)
    side = lambda df, first: df.select(*keys, (row if first else none).alias("x"), (none if first else row).alias("y"))
    both = side(a, True).unionByName(side(b, False)).groupBy(*keys).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    x, y = F.col("x").isNotNull(), F.col("y").isNotNull()
    changed = {f: x & y & ~F.col("x")[f].eqNullSafe(F.col("y")[f]) for f in fields}
    was, now = F.col("x._right"), F.col("y._right")
    counts = {"first_rows": x, "second_rows": y, "matched": x & y, "only_first": x & ~y, "only_second": ~x & y, **{f"{f}_changed": c for f, c in changed.items()}}
    counts |= {"newly_right": x & y & ~was & now, "lost_right": x & y & was & ~now, "any_changed": reduce(lambda p, q: p | q, changed.values())}
    return both.groupBy(*by).agg(*(one(c).alias(n) for n, c in counts.items()))


def unexplained_changes(changes: DataFrame, causes: DataFrame, covers: DataFrame, selected: DataFrame, slices: list[str]) -> DataFrame:
    """Changed cells that no changed query explains: one that covers the cell and was selected in the cell's slice.

    changes: slices + cell_id; causes: query_id; covers: query_id, cell_id; selected: slices + query_id.
    """
    explained = covers.join(causes.select("query_id").distinct(), "query_id", "left_semi").join(selected.select(*slices, "query_id").distinct(), "query_id").select(*slices, "cell_id").distinct()
    return changes.join(explained, [*slices, "cell_id"], "left_anti")


def content_digest(df: DataFrame, columns: list[Column], parts: int = 256) -> DataFrame:
    """One digest of a table's rows whatever their order: digests of hash parts, then a digest of those.

    A part's row digests are sorted within the part; parts grow with the table's width, never one list of
    the whole table, as long as `parts` is chosen with its size.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    per = df.select(row.alias("h")).groupBy(F.substring("h", 1, 8).alias("p")).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("d"), F.count("*").alias("n"))
    top = per.groupBy(F.pmod(F.xxhash64("p"), F.lit(parts)).alias("part")).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list(F.concat("p", "d")))), 256).alias("d"), F.sum("n").alias("n"))
    return top.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list(F.concat(F.col("part").cast("string"), "d")))), 256).alias("digest"), F.sum("n").alias("rows"))


def set_overlap(sets: DataFrame, keys: list[str], left: Column, right: Column, member: str) -> DataFrame:
    """Sizes of two cell sets per key, of what they share and have together, both directional rates and Jaccard's."""
    per = sets.groupBy(*keys, member).agg(F.max(left.cast("int")).alias("a"), F.max(right.cast("int")).alias("b"))
    out = per.groupBy(*keys).agg(F.sum("a").alias("size_a"), F.sum("b").alias("size_b"), F.sum(F.col("a") * F.col("b")).alias("shared"), F.sum(F.greatest("a", "b")).alias("together"))
    r = lambda n, d: F.when(F.col(d) > 0, F.round(F.col(n) / F.col(d), 9)).otherwise(0.0)
    return out.withColumns({"of_a": r("shared", "size_a"), "of_b": r("shared", "size_b"), "jaccard": r("shared", "together")})


def missing_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, missing, rows): rows in which a field is null or blank, in one pass."""
    lacks = [F.sum((F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")).cast("int")).alias(f"_{i}") for i, f in enumerate(fields)]
    one = df.agg(F.count("*").alias("rows"), *lacks)
    return one.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("missing"), F.col("rows")) for i, f in enumerate(fields)))))
