"""Functional dependencies: violating groups, components, and conflicts before and after a repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violating_groups(table: DataFrame, determinant: list[str], dependent: str) -> DataFrame:
    """(determinant..., members, dependents, violation_pair_count) of the keys with more than one dependent value.

    Counts are taken per (key, dependent) first, so a key of any size is a few rows. Empty texts are
    values like others.
    """
    per = table.groupBy(*determinant, dependent).agg(F.count("*").alias("c"))
    own = per.groupBy(*determinant).agg(F.sum("c").alias("members"), F.count("*").alias("dependents"), F.sum(F.expr("c * (c - 1) div 2")).alias("same"))
    pairs = F.expr("members * (members - 1) div 2") - F.col("same")
    return own.where("dependents > 1").select(*determinant, "members", "dependents", pairs.alias("violation_pair_count"))


def component_id(suite, dataset, rule, *key):
    """24 hex digits of what names a component."""
    return F.substring(F.sha2(F.concat_ws("\x1f", suite, dataset, rule, *key), 256), 1, 24)


def violation_members(table: DataFrame, found: DataFrame, row: str, determinant: list[str], dependent: str, columns: list[str], suite: str, dataset: str, rule: str) -> DataFrame:
    """(component_id, cell_id): error cells of the rule's columns in violating groups."""
    at = [columns.index(c) for c in [*determinant, dependent]]
    groups = violating_groups(table, determinant, dependent)
    key = [F.col(c) for c in determinant]
    rows = table.select(F.col(row).alias("row_idx"), *determinant).join(groups, determinant)
    rows = rows.select("row_idx", component_id(F.lit(suite), F.lit(dataset), F.lit(rule), *key).alias("component_id"), "violation_pair_count")
    return found.where(F.col("col_idx").isin(*at)).select("cell_id", "row_idx").join(rows, "row_idx").select("component_id", "cell_id", "violation_pair_count")


def conflicts(table: DataFrame, candidates: DataFrame, row: str, determinant: list[str], dependent: str) -> DataFrame:
    """candidates (row_idx, column_name, candidate, ...) with fd_before and fd_after.

    The number of other rows that agree with a row on the determinant and not on the dependent, as the
    table stands and with the candidate put in. Rows with an empty value on either side conflict with
    none. Both follow from counts by key and by key and dependent, so no row meets its peers.
    """
    side = [*determinant, dependent]
    full = lambda cols: F.forall(F.array(*cols), lambda x: x != "")
    valid = table.where(full([F.col(c) for c in side]))
    by_key = valid.groupBy(*determinant).agg(F.count("*").alias("_k"))
    by_both = valid.groupBy(*side).agg(F.count("*").alias("_kd"))
    t = candidates.join(table.select(F.col(row).alias("row_idx"), *side), "row_idx")
    t = t.withColumns({f"_n_{c}": F.when(F.col("column_name") == c, F.col("candidate")).otherwise(F.col(c)) for c in side})
    t = t.withColumns({"_own": full([F.col(c) for c in side]), "_new": full([F.col(f"_n_{c}") for c in side])})
    t = t.join(by_key, determinant, "left").join(by_both, side, "left")
    new = lambda df, cols, n: df.select(*(F.col(c).alias(f"_n_{c}") for c in cols), F.col(n).alias(f"{n}2"))
    t = t.join(new(by_key, determinant, "_k"), [f"_n_{c}" for c in determinant], "left").join(new(by_both, side, "_kd"), [f"_n_{c}" for c in side], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    same_key = F.col("_own") & F.forall(F.array(*(F.col(c) == F.col(f"_n_{c}") for c in determinant)), lambda x: x)
    same_both = same_key & (F.col(dependent) == F.col(f"_n_{dependent}"))
    before = F.when(F.col("_own"), zero("_k") - zero("_kd")).otherwise(0)
    after = F.when(F.col("_new"), (zero("_k2") - same_key.cast("int")) - (zero("_kd2") - same_both.cast("int"))).otherwise(0)
    return t.withColumns({"fd_before": before.cast("long"), "fd_after": after.cast("long")}).select(*candidates.columns, "fd_before", "fd_after")
