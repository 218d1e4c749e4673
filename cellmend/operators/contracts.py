"""What tables must hold before they are used: exact numbers, whole joins, full coverage; and how selections compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what a slice is called where nothing is said
SLICE_DEFAULTS = {"scenario": "main", "backend": "none", "group_size_variant": "all"}


def non_negative(x: Column) -> Column:
    """A number, 0 where it is null, negative or not finite."""
    v = x.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf")), v).otherwise(0.0)


def exact_integer(x: Column) -> Column:
    """A text or number as a whole number of up to 38 digits, null where it isn't one; 3.0 is one, 3.5 and true aren't."""
    text = F.trim(x.cast("string"))
    whole = F.regexp_extract(text, r"^([+-]?\d{1,38})(?:\.0*)?$", 1)
    return F.when(whole != "", whole).cast("decimal(38,0)")


def slice_defaults(df: DataFrame, budget: str = "budget_share") -> DataFrame:
    """df with default names for empty slice columns, and budget_ok: the budget is null, or finite and not negative."""
    named = {c: F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.lit(d)) for c, d in SLICE_DEFAULTS.items() if c in df.columns}
    b = F.col(budget).cast("double")
    return df.withColumns({**named, "budget_ok": b.isNull() | (~F.isnan(b) & (b >= 0) & (b < float("inf")))})


def executable(decision: Column, repair: Column, dirty: Column, base: Column) -> Column:
    """A proposal that would change something: not empty, neither the dirty nor the base value. Values are normalised ones, null being empty."""
    value = F.coalesce(repair, F.lit(""))
    return (F.lower(F.trim(F.coalesce(decision, F.lit("")))) == "propose") & (value != "") & (value != F.coalesce(dirty, F.lit(""))) & (value != F.coalesce(base, F.lit("")))


def observed_sizes(actions: DataFrame, sizes: list[int], size: str = "size") -> DataFrame:
    """(size, declared, queries): every declared or observed size; a declared one without queries breaks the variant."""
    declared = actions.sparkSession.createDataFrame([(s,) for s in sorted({*sizes})], f"{size} int").withColumn("declared", F.lit(True))
    per = actions.groupBy(F.col(size).cast("int").alias(size)).agg(F.count("*").alias("queries"))
    return declared.join(per, size, "full_outer").select(size, F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("queries", F.lit(0)).alias("queries"))


def of_sizes(actions: DataFrame, sizes: list[int], size: str = "size") -> DataFrame:
    """Actions of the declared sizes; a size that no action has is refused."""
    lacking = [r[0] for r in observed_sizes(actions, sizes, size).where("declared and queries = 0").collect()]  # no more than are declared
    if lacking:
        raise ValueError(f"no query has size {sorted(lacking)}")
    return actions.where(F.col(size).isin(*sizes))


def join_violations(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lefts, rights): keys that aren't met exactly once on each side. A one-to-one join has none."""
    n = lambda df, a, b: df.select(*keys, F.lit(a).alias("l"), F.lit(b).alias("r"))
    both = n(left, 1, 0).unionByName(n(right, 0, 1)).groupBy(*keys).agg(F.sum("l").alias("lefts"), F.sum("r").alias("rights"))
    return both.where("lefts <> 1 or rights <> 1")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The join of two tables that hold each key once, refused where they don't."""
    if not join_violations(left, right, keys).isEmpty():
        raise ValueError(f"{keys} don't pair the two tables one to one")
    return left.join(right, keys)


def without_datasets(df: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of data sets that aren't excluded; an excluded data set that df doesn't hold is refused."""
    strange = excluded.select(*keys).distinct().join(df.select(*keys).distinct(), keys, "left_anti")
    if not strange.isEmpty():
        raise ValueError("a data set that isn't there can't be excluded")
    return df.join(excluded.select(*keys).distinct(), keys, "left_anti")


def union_of_columns(tables: list[DataFrame]) -> DataFrame:
    """All rows of ledgers whose columns differ; columns in the order in which they are first met, nulls where a ledger lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merged_usage(rows: DataFrame, keys: list[str], usage: str) -> DataFrame:
    """(keys, usage, complete): sums of every counter of the usage maps, and whether each row had one. Null counters count as 0."""
    x = rows.withColumn("_there", F.col(usage).isNotNull() & (F.size(usage) > 0))
    per = x.groupBy(*keys).agg(F.min("_there").alias("complete"))
    sums = x.where("_there").select(*keys, F.explode(usage).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum(non_negative(F.col("_v"))).alias("_v"))
    maps = sums.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(usage))  # a counter once each
    return per.join(maps, keys, "left").select(*keys, usage, "complete")


# ---- costs and selections

def singleton_costs(actions: DataFrame) -> DataFrame:
    """(cell_id, singleton_cost): the cost of asking a cell alone, the smallest where several queries do; costs that aren't positive don't count."""
    alone = actions.where("size = 1 and query_cost > 0")
    return alone.groupBy(F.col("cell_ids")[0].alias("cell_id")).agg(F.min("query_cost").alias("singleton_cost"))


def group_savings(actions: DataFrame) -> DataFrame:
    """actions (query_id, cell_ids, size, query_cost) with singleton_sum and saving_ratio against asking their cells alone.

    A query with a cell that no singleton asks has neither.
    """
    members = actions.select("query_id", F.explode("cell_ids").alias("cell_id")).join(singleton_costs(actions), "cell_id", "left")
    sums = members.groupBy("query_id").agg(F.sum("singleton_cost").alias("_s"), F.count("*").alias("_n"), F.count("singleton_cost").alias("_k"))
    x = actions.join(sums, "query_id", "left").withColumn("singleton_sum", F.when(F.col("_n") == F.col("_k"), F.col("_s")))
    return x.withColumn("saving_ratio", F.when(F.col("singleton_sum") > 0, 1 - F.col("query_cost") / F.col("singleton_sum"))).drop("_s", "_n", "_k")


def selection_audit(selected: DataFrame, slices: list[str], budget: str = "budget") -> DataFrame:
    """Per slice: queries, groups, cost, slack of the budget, different cells and incidences, and how often cells are met again.

    selected: slices, query_id, cell_ids, query_cost and the slice's budget.
    """
    per = selected.groupBy(*slices).agg(F.count("*").alias("queries"), F.sum((F.size("cell_ids") > 1).cast("int")).alias("groups"), F.sum("query_cost").alias("cost"), F.max(budget).alias(budget), F.sum(F.size("cell_ids")).alias("incidences"))
    cells = selected.select(*slices, F.explode("cell_ids").alias("_c")).groupBy(*slices).agg(F.countDistinct("_c").alias("cells"))
    x = per.join(cells, slices)
    return x.withColumns({"slack": F.col(budget) - F.col("cost"), "within": F.col("cost") <= F.col(budget), "overlap": F.round(1 - F.col("cells") / F.col("incidences"), 9)})


def selection_differences(old: DataFrame, new: DataFrame, slices: list[str]) -> DataFrame:
    """Per slice: queries added, removed and kept, Jaccard's index, and whether both are equal. Two empty selections are equal."""
    side = lambda df, a, b: df.select(*slices, "query_id").distinct().select("*", F.lit(a).alias("o"), F.lit(b).alias("w"))
    both = side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy(*slices, "query_id").agg(F.max("o").alias("o"), F.max("w").alias("w"))
    n = lambda c: F.sum(c.cast("int"))
    o, w = F.col("o") == 1, F.col("w") == 1
    per = both.groupBy(*slices).agg(n(w & ~o).alias("added"), n(o & ~w).alias("removed"), n(o & w).alias("kept"), F.count("*").alias("_all"))
    return per.withColumns({"jaccard": F.round(F.col("kept") / F.col("_all"), 9), "equal": F.col("kept") == F.col("_all")}).drop("_all")


def selection_difference_summary(differences: DataFrame, by: str) -> DataFrame:
    """Slices, changed ones, mean and least Jaccard's index and whether all are equal, per value of `by` and over ALL."""
    d = differences.rollup(by).agg(F.grouping(by).alias("_g"), F.count("*").alias("slices"), F.sum((~F.col("equal")).cast("int")).alias("changed"), F.round(F.avg("jaccard"), 9).alias("mean_jaccard"), F.min("jaccard").alias("min_jaccard"), F.bool_and("equal").alias("all_equal"))
    return d.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col(by)).alias(by), "slices", "changed", "mean_jaccard", "min_jaccard", "all_equal")


def metric_delta_rows(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(keys, field, before, after, delta, state): every field of two summaries side by side; rows of one side only have state missing or extra.

    Null keys are equal. A field is `same` where both are null or they differ by the tolerance at most.
    """
    row = F.struct(*(F.col(f).cast("double").alias(f) for f in fields))
    none = F.lit(None).cast(row_type(fields))
    side = lambda df, first: df.select(*keys, (row if first else none).alias("x"), (none if first else row).alias("y"))
    both = side(old, True).unionByName(side(new, False)).groupBy(*keys).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    items = [F.struct(F.lit(f).alias("field"), F.col("x")[f].alias("before"), F.col("y")[f].alias("after")) for f in fields]
    long = both.select(*keys, F.col("x").isNotNull().alias("_x"), F.col("y").isNotNull().alias("_y"), F.inline(F.array(*items)))
    a, b = F.col("before"), F.col("after")
    same = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    state = F.when(~F.col("_y"), "missing").when(~F.col("_x"), "extra").when(same, "same").otherwise("changed")
    return long.select(*keys, "field", "before", "after", (b - a).alias("delta"), state.alias("state"))


def row_type(fields: list[str]) -> str:
    return "struct<" + ",".join(f"`{f}`:double" for f in fields) + ">"


# ---- partitions and coverage

def partition_coverage(members: DataFrame, condition: list[str], k: int) -> DataFrame:
    """(condition, cells, blocks, covered, left_out, eligible): how many cells of a condition blocks of k take; three blocks make it eligible."""
    per = members.groupBy(*condition).agg(F.count("*").alias("cells"))
    return per.select(*condition, "cells", F.expr(f"cells div {k}").alias("blocks"), F.expr(f"cells div {k} * {k}").alias("covered"), F.expr(f"cells - cells div {k} * {k}").alias("left_out"), F.expr(f"cells div {k} >= 3").alias("eligible"))


def partition_mismatches(structured: DataFrame, random: DataFrame, condition: list[str]) -> DataFrame:
    """(condition, reason): conditions whose random blocks don't match the chosen ones. Both: condition, block, member_index, cell_id.

    They must have the same cells, each cell at its place in its block, and no block with equal cells in both.
    """
    place = [*condition, "cell_id", "member_index"]
    one = lambda df, a, b: df.select(*place, F.lit(a).alias("s"), F.lit(b).alias("r"))
    moved = one(structured, 1, 0).unionByName(one(random, 0, 1)).groupBy(*place).agg(F.sum("s").alias("s"), F.sum("r").alias("r")).where("s <> r").select(*condition, F.lit("place").alias("reason"))
    block = lambda df: df.groupBy(*condition, "block").agg(F.array_sort(F.collect_list("cell_id")).alias("cells"))  # noqa: E731  a block has few members
    equal = block(structured).drop("block").join(block(random).drop("block"), [*condition, "cells"], "left_semi").select(*condition, F.lit("equal_block").alias("reason"))
    return moved.unionByName(equal).distinct()


def selection_coverage(selected: DataFrame, scored: DataFrame, slices: list[str]) -> DataFrame:
    """(slices, query_id, cell_id, state): members of selected queries without a score, or scores of pairs that no selected query has."""
    pairs = selected.select(*slices, "query_id", F.explode("cell_ids").alias("cell_id")).distinct()
    known = scored.join(selected.select(*slices, "query_id").distinct(), [*slices, "query_id"], "left_semi").select(*slices, "query_id", "cell_id").distinct()
    key = [*slices, "query_id", "cell_id"]
    return pairs.join(known, key, "left_anti").select(*key, F.lit("missing").alias("state")).unionByName(known.join(pairs, key, "left_anti").select(*key, F.lit("extra").alias("state")))


def calibration_labels(actions: DataFrame, results: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per cell and query: base_correct, llm_correct, executable, helpful, harmful, as 0 or 1.

    actions: query_id, cell_ids; results: query_id, cell_id, decision, repair (a query or cell without one has
    no answer); cells: cell_id, dirty_value, clean_value, base_value. Values are normalised ones.
    """
    pairs = actions.select("query_id", F.explode("cell_ids").alias("cell_id")).join(cells.select("cell_id", "dirty_value", "clean_value", "base_value"), "cell_id")
    x = pairs.join(results.select("query_id", "cell_id", "decision", "repair"), ["query_id", "cell_id"], "left")
    runs = executable(F.col("decision"), F.col("repair"), F.col("dirty_value"), F.col("base_value"))
    x = x.withColumns({"base_correct": F.coalesce((F.col("base_value") == F.col("clean_value")).cast("int"), F.lit(0)), "executable": runs.cast("int")})
    x = x.withColumn("llm_correct", F.when(F.col("executable") == 1, (F.col("repair") == F.col("clean_value")).cast("int")).otherwise(0))
    b, m, e = F.col("base_correct"), F.col("llm_correct"), F.col("executable")
    return x.select("query_id", "cell_id", "base_correct", "llm_correct", "executable", (e * m * (1 - b)).alias("helpful"), (e * b * (1 - m)).alias("harmful"))
