"""Three ways of asking the same cells held against each other: alone, in chosen groups, in random groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.operators.ledger import SUCCESS
from cellmend.operators.metrics import holm
from cellmend.operators.statistics import mcnemar

# fixed values: parts of a parse status that tell of an answer that couldn't be read
UNREADABLE = ["parse_failure", "no_json", "invalid_json", "malformed", "query_id_mismatch", "invalid_repairs", "no_valid_items", "duplicate_cell", "unknown_cell"]
# fixed values: the ways in which an answer isn't valid, in the order in which they are tested, and the arms
INVALID = ["provider_failure", "parse_failure", "missing", "abstain", "empty", "unchanged", "other_invalid"]
ARMS = ["singleton", "structured", "random"]
CONTRASTS = [("structured", "singleton"), ("random", "singleton"), ("structured", "random")]
RATES = [
    *(f"{a}_accuracy" for a in ARMS),
    *(f"{a}_{what}_rate" for a in ARMS[1:] for what in ("rescue", "interference")),
    *(f"{a}_minus_{b}" for a, b in CONTRASTS),
    *(f"{a}_{state}_rate" for state in ("invalid", *INVALID) for a in ARMS),
]


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def is_unreadable(parse_status: Column) -> Column:
    """Whether a parse status tells of an answer that couldn't be read, in any letter case."""
    return _plain(parse_status).rlike("|".join(UNREADABLE))


def is_valid(status: Column, parse_status: Column, decision: Column, prediction: Column, dirty: Column) -> Column:
    """A successful, parsed proposal of a value that is neither empty nor the dirty one; predictions and dirty values are normalised ones, null being empty."""
    value = F.coalesce(prediction, F.lit(""))
    return _plain(status).isin(*SUCCESS) & _plain(parse_status).isin("ok", "partial") & (_plain(decision) == "propose") & (value != "") & (value != F.coalesce(dirty, F.lit("")))


def failure_state(status: Column, parse_status: Column, decision: Column, prediction: Column, dirty: Column) -> Column:
    """`valid` or the first of the seven ways in which an answer isn't."""
    parse, said, value = _plain(parse_status), _plain(decision), F.coalesce(prediction, F.lit(""))
    return (
        F.when(~_plain(status).isin(*SUCCESS) | parse.contains("provider"), "provider_failure")
        .when(is_unreadable(parse_status), "parse_failure")
        .when((said == "") | parse.contains("missing"), "missing")
        .when((said == "abstain") | parse.contains("abstain"), "abstain")
        .when(value == "", "empty")
        .when(value == F.coalesce(dirty, F.lit("")), "unchanged")
        .when(~is_valid(status, parse_status, decision, prediction, dirty), "other_invalid")
        .otherwise("valid")
    )


def with_states(cells: DataFrame) -> DataFrame:
    """cells (dirty_value, clean_value, and status, parse_status, decision, prediction of every arm) with <arm>_state and <arm>_correct."""
    out = {}
    for a in ARMS:
        args = [F.col(f"{a}_{c}") for c in ("status", "parse_status", "decision", "prediction")]
        out[f"{a}_state"] = failure_state(*args, F.col("dirty_value"))
        out[f"{a}_correct"] = is_valid(*args, F.col("dirty_value")) & (F.coalesce(F.col(f"{a}_prediction"), F.lit("")) == F.coalesce("clean_value", F.lit("")))
    return cells.withColumns(out)


def _indicators() -> dict[str, Column]:
    right = {a: F.col(f"{a}_correct").cast("int") for a in ARMS}
    out = {f"{a}_accuracy": right[a] for a in ARMS}
    for a in ARMS[1:]:
        out[f"{a}_rescue_rate"] = right[a] * (1 - right["singleton"])
        out[f"{a}_interference_rate"] = right["singleton"] * (1 - right[a])
    out |= {f"{a}_minus_{b}": right[a] - right[b] for a, b in CONTRASTS}
    for a in ARMS:
        out[f"{a}_invalid_rate"] = (F.col(f"{a}_state") != "valid").cast("int")
        out |= {f"{a}_{s}_rate": (F.col(f"{a}_state") == s).cast("int") for s in INVALID}
    return {n: out[n] for n in RATES}


PLACE = ["scope", "suite", "dataset", "source_view", "group_size"]


def _scopes(per: DataFrame, sums: list[str]) -> DataFrame:
    """Sums per data set and condition brought to every scope; macro scopes hold plain means of the data sets' rates."""
    per = per.withColumn("group_size", F.col("group_size").cast("string"))
    every = F.lit("ALL")

    def level(df: DataFrame, scope: str, **names: Column | str) -> DataFrame:
        place = [F.lit(scope).alias("scope"), *(names.get(c, F.col(c)).alias(c) for c in PLACE[1:])]
        return df.groupBy(*place).agg(F.sum("n").alias("n"), F.sum("cells").alias("cells"), *(F.sum(s).alias(s) for s in sums))

    def rates(df: DataFrame) -> DataFrame:
        return df.select(*PLACE, "n", "cells", *((F.col(s) / F.col("n")).alias(s) for s in sums))

    def macro(df: DataFrame, scope: str, **names: Column) -> DataFrame:
        place = [F.lit(scope).alias("scope"), every.alias("suite"), F.lit("MACRO").alias("dataset"), *(names.get(c, F.col(c)).alias(c) for c in PLACE[3:])]
        return df.groupBy(*place).agg(F.sum("n").alias("n"), F.sum("cells").alias("cells"), *(F.avg(s).alias(s) for s in sums))

    whole = dict(source_view=every, group_size=every)
    own, overall = rates(level(per, "dataset")), rates(level(per, "dataset", **whole))
    parts = [
        own, rates(level(per, "suite", dataset=every)), rates(level(per, "micro", suite=every, dataset=F.lit("MICRO"))), macro(own, "macro"),
        rates(level(per, "micro_all_conditions", suite=every, dataset=F.lit("MICRO"), **whole)), macro(overall, "macro_all_conditions", **whole),
    ]
    return reduce(DataFrame.unionByName, parts)


def group_metrics(cells: DataFrame) -> DataFrame:
    """The 34 rates per scope, view and size, with the cells met (n) and the different ones among them (cells).

    Scopes: every data set, every suite, all cells of a condition (micro), the plain mean of its data sets
    (macro), and both over all conditions. cells: suite, dataset, source_view, group_size, cell_id, and
    what with_states needs. One aggregation over the cells; all else comes from its rows.
    """
    x = with_states(cells)
    per = x.groupBy("suite", "dataset", "source_view", "group_size").agg(F.count("*").alias("n"), F.countDistinct("cell_id").alias("cells"), *(F.sum(e).alias(n) for n, e in _indicators().items()))
    return _scopes(per, RATES)


def identity_violations(metrics: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Rows of group_metrics that break one of the three identities between rates; there are none."""
    c = F.col
    broken = [
        c("structured_minus_singleton") - (c("structured_rescue_rate") - c("structured_interference_rate")),
        c("random_minus_singleton") - (c("random_rescue_rate") - c("random_interference_rate")),
        c("structured_minus_singleton") - (c("random_minus_singleton") + c("structured_minus_random")),
    ]
    return metrics.where(reduce(lambda a, b: a | b, (F.abs(e) > tolerance for e in broken))).select(*PLACE)


def group_transitions(cells: DataFrame) -> DataFrame:
    """Both, treatment only, baseline only, neither right, per scope, condition and contrast, with McNemar's p and Holm's within the scope.

    Families of tests: the conditions of the micro scope, and those of all data sets. Counts of the macro
    scope are those of micro, and it has no test.
    """
    x = with_states(cells)
    flags = {}
    for a, b in CONTRASTS:
        p, q, name = F.col(f"{a}_correct"), F.col(f"{b}_correct"), f"{a}_minus_{b}"
        flags |= {f"{name}|both": p & q, f"{name}|treatment": p & ~q, f"{name}|baseline": ~p & q, f"{name}|neither": ~p & ~q}
    per = x.groupBy("suite", "dataset", "source_view", F.col("group_size").cast("string").alias("group_size")).agg(*(F.sum(e.cast("int")).alias(n) for n, e in flags.items()))
    every = F.lit("ALL")
    parts = []
    for scope, names in (("dataset", {}), ("suite", {"dataset": every}), ("micro", {"suite": every, "dataset": F.lit("MICRO")})):
        place = [F.lit(scope).alias("scope"), *(names.get(c, F.col(c)).alias(c) for c in PLACE[1:])]
        parts.append(per.groupBy(*place).agg(*(F.sum(n).alias(n) for n in flags)))
    wide = reduce(DataFrame.unionByName, parts)
    kinds = ["both", "treatment", "baseline", "neither"]
    rows = [F.struct(F.lit(f"{a}_minus_{b}").alias("contrast"), *(F.col(f"{a}_minus_{b}|{k}").alias(k) for k in kinds)) for a, b in CONTRASTS]
    long = wide.select(*PLACE, F.inline(F.array(*rows))).withColumn("p", mcnemar(F.col("treatment"), F.col("baseline")))
    named = long.withColumn("_test", F.concat_ws("/", "suite", "dataset", "source_view", "group_size", "contrast"))
    return holm(named, ["scope"], "p", "_test").drop("_test")
