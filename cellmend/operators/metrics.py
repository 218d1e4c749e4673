"""Grouped quality, cost and paired measures with data set, micro and macro scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmend.functions.scalars import f1, rate
from cellmend.operators.grouping import ranks

SERIES = ["method_name", "scenario", "backend", "budget_share", "group_size_variant"]
COUNTS = ["true_error_cells", "valid_predictions", "correct_repairs"]
QUADRANTS = ["n11", "n10", "n01", "n00"]


def _rates(df: DataFrame) -> DataFrame:
    p, r = rate(F.col("correct_repairs"), F.col("valid_predictions")), rate(F.col("correct_repairs"), F.col("true_error_cells"))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def summarize(records: DataFrame, valid: Column, correct: Column, series: list[str] = SERIES) -> DataFrame:
    """Counts and rates per series and data set, over all cells (micro), and as plain means of data sets (macro).

    One pass over the records; micro and macro come from the rows per data set.
    """
    per = _rates(records.groupBy(*series, "suite", "dataset").agg(F.count("*").alias("true_error_cells"), F.sum(valid.cast("int")).alias("valid_predictions"), F.sum((valid & correct).cast("int")).alias("correct_repairs")))
    names = [*series, "suite", "dataset", "scope", *COUNTS, "precision", "recall", "f1"]
    sums = [F.sum(c).alias(c) for c in COUNTS]
    labels = lambda scope: [F.lit("ALL").alias("suite"), F.lit(scope.upper()).alias("dataset"), F.lit(scope).alias("scope")]
    micro = _rates(per.groupBy(*series).agg(*sums)).select("*", *labels("micro")).select(*names)
    macro = per.groupBy(*series).agg(*sums, *(F.avg(c).alias(c) for c in ("precision", "recall", "f1"))).select("*", *labels("macro")).select(*names)
    return per.withColumn("scope", F.lit("dataset")).select(*names).unionByName(micro).unionByName(macro)


def deltas(summary: DataFrame, baseline: str, fields: list[str], dims: tuple[str, ...] = ("scenario", "backend", "budget_share", "group_size_variant")) -> DataFrame:
    """Every row of another method with the baseline's value of its slice and place, and the difference.

    The baseline's slice is the one with equal dimensions, else that of the place where all its slices there
    agree, see matched_baseline; rows without either are left out, so no row is ever repeated.
    """
    place, method = ["scope", "suite", "dataset"], F.col("method_name") == baseline
    dims = [c for c in dims if c in summary.columns]
    other = matched_baseline(summary.where(~method), summary.where(method), place, dims, fields).where(F.col("state").isin("exact", "place")).drop("state")
    return other.select("*", *((F.col(f) - F.col(f"baseline_{f}")).alias(f"{f}_delta") for f in fields))


def matched_baseline(rows: DataFrame, baseline: DataFrame, place: list[str], dims: list[str], fields: list[str]) -> DataFrame:
    """rows with baseline_<field>: of the baseline's slice with equal dimensions, else of its place if all its slices there agree.

    Places where they disagree, or that the baseline lacks, have nulls and state 'ambiguous' or 'missing'.
    """
    exact = baseline.select(*place, *(F.col(c).alias(f"_d_{c}") for c in dims), F.struct(*fields).alias("_e")).dropDuplicates([*place, *(f"_d_{c}" for c in dims)])
    anywhere = baseline.groupBy(*place).agg(F.min(F.struct(*fields)).alias("_lo"), F.max(F.struct(*fields)).alias("_hi"))
    same = [rows[c] == exact[c] for c in place] + [rows[c].eqNullSafe(exact[f"_d_{c}"]) for c in dims]
    x = rows.join(exact, same, "left").select(rows["*"], "_e").join(anywhere, place, "left")
    agree = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
    state = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_lo").isNull(), "missing").when(agree.isNotNull(), "place").otherwise("ambiguous")
    return x.withColumn("state", state).withColumn("_b", F.coalesce("_e", agree)).select(*rows.columns, "state", *(F.col("_b")[f].alias(f"baseline_{f}") for f in fields))


def budget_curve_area(points: DataFrame, keys: list[str], budget: str, value: str, anchor: str, top: float) -> DataFrame:
    """Area under value over budget on [0, top] by trapezoids, from the anchor at 0, divided by top. Curves that don't reach top are left out."""
    pts = points.where(F.col(budget) > 0).select(*keys, F.col(budget).alias("x"), F.col(value).alias("y")).unionByName(points.select(*keys, F.lit(0.0).alias("x"), F.col(anchor).alias("y")).distinct())
    w = Window.partitionBy(*keys).orderBy("x")
    area = (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2
    out = pts.withColumn("a", area).groupBy(*keys).agg((F.sum("a") / top).alias("area"), F.max("x").alias("reach"), F.count("*").alias("points"))
    return out.where(F.abs(F.col("reach") - top) <= 1e-12).drop("reach")


def quadrants(pairs: DataFrame, first: Column, second: Column, sets: list[list[str]]) -> DataFrame:
    """n11, n10, n01, n00 for each grouping set in one pass; columns a set lacks are ALL."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    n = lambda a, b: F.sum(F.when((first if a else ~first) & (second if b else ~second), 1).otherwise(0)).alias(f"n{int(a)}{int(b)}")
    g = pairs.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(n(True, True), n(True, False), n(False, True), n(False, False), *(F.grouping(c).alias(f"_g_{c}") for c in columns))
    return g.select(*(F.when(F.col(f"_g_{c}") == 1, "ALL").otherwise(F.col(c)).alias(c) for c in columns), *QUADRANTS)


def complementarity_rates(q: DataFrame) -> DataFrame:
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    r = lambda top: F.when(n > 0, F.round(top / n, 9)).otherwise(F.lit(float("nan")))
    a, b, c = F.col("n11"), F.col("n10"), F.col("n01")
    return q.withColumns({"base_accuracy": r(a + b), "llm_accuracy": r(a + c), "union_accuracy": r(a + b + c), "rescue_rate": r(c), "harm_rate": r(b), "disagreement": r(b + c), "net": r(c - b)})


def complementarity_full(cells: DataFrame, family: str, base: Column, llm: Column, valid: Column) -> DataFrame:
    """Quadrants and eleven rates per data set, suite, family, over all cells (micro) and as means of data sets (macro).

    One pass over the cells; a rate whose divisor is 0 is null and doesn't count in a mean.
    """
    n = lambda c: F.sum(c.cast("int"))
    per = cells.groupBy("suite", "dataset", family).agg(n(base & llm).alias("n11"), n(base & ~llm).alias("n10"), n(~base & llm).alias("n01"), n(~base & ~llm).alias("n00"), n(valid).alias("valid"))
    every, counts = F.lit("ALL"), [*QUADRANTS, "valid"]

    def level(scope: str, suite: Column, dataset: Column) -> DataFrame:
        return per.groupBy(F.lit(scope).alias("scope"), suite.alias("suite"), dataset.alias("dataset")).agg(*(F.sum(c).alias(c) for c in counts))

    c = level("dataset", F.col("suite"), F.col("dataset")).unionByName(level("suite", F.col("suite"), every)).unionByName(level("family", every, F.col(family))).unionByName(level("micro", every, F.lit("MICRO")))
    n11, n10, n01, n00, ok = (F.col(x) for x in counts)
    whole = n11 + n10 + n01 + n00
    ratio = lambda top, under: F.when(under != 0, top / under)
    rates = {
        "base_accuracy": ratio(n11 + n10, whole), "llm_accuracy": ratio(n11 + n01, whole), "union_accuracy": ratio(n11 + n10 + n01, whole), "union_minus_base": ratio(n01, whole), "union_minus_best": ratio(F.least(n10, n01), whole),
        "llm_salvage_rate": ratio(n01, n01 + n00), "base_rescue_rate": ratio(n10, n10 + n00), "disagreement_rate": ratio(n10 + n01, whole), "llm_precision": ratio(n11 + n01, ok), "llm_recall": ratio(n11 + n01, whole),
    }
    p, r = F.col("llm_precision"), F.col("llm_recall")
    full = c.withColumns(rates).withColumn("llm_f1", F.when(p.isNotNull() & (p + r > 0), 2 * p * r / (p + r)).otherwise(0.0))
    names = [*rates, "llm_f1"]
    macro = full.where("scope = 'dataset'").agg(*(F.sum(x).alias(x) for x in counts), *(F.avg(x).alias(x) for x in names)).select(F.lit("macro").alias("scope"), every.alias("suite"), F.lit("MACRO").alias("dataset"), *counts, *names)
    return full.unionByName(macro).select("scope", "suite", "dataset", *counts, *(F.round(x, 9).alias(x) for x in names))


def cluster_matrix(records: DataFrame, keys: list[str], cluster: Column, series: str, valid: Column, right: Column, cell: str = "cell_id") -> DataFrame:
    """(keys, cluster, series, cells, valid, correct): of a cell's rows in one series any valid or right one counts."""
    per = records.groupBy(*keys, cluster.alias("cluster"), series, cell).agg(F.max(valid).alias("v"), F.max(right).alias("r"))
    return per.groupBy(*keys, "cluster", series).agg(F.count("*").alias("cells"), F.sum(F.col("v").cast("int")).alias("valid"), F.sum(F.col("r").cast("int")).alias("correct"))


def average_precision(scored: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Step-wise area under precision and recall, equal scores taken together, with prevalence and the Brier score."""
    per = scored.groupBy(*keys, score).agg(F.sum(label).alias("p"), F.count("*").alias("n"), F.sum((F.col(score) - F.col(label)) ** 2).alias("se"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"tp": F.sum("p").over(w), "seen": F.sum("n").over(w)})
    return per.groupBy(*keys).agg(F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("s"), F.sum("p").alias("positives"), F.sum("n").alias("n"), F.sum("se").alias("se")).select(
        *keys, "n", "positives", F.when(F.col("positives") > 0, F.col("s") / F.col("positives")).otherwise(0.0).alias("average_precision"), (F.col("se") / F.col("n")).alias("brier"), (F.col("positives") / F.col("n")).alias("prevalence")
    )


def top_share(spark: SparkSession, rows: DataFrame, keys: list[str], order: list[str], share: float) -> DataFrame:
    """The first ceil(share * n) rows of every key in order, one at least. Ranked without sorting a key in one task."""
    ranked = ranks(spark, rows, keys, order)
    return ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("members")))).drop("rank", "members")


def nearest_rank(values: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Percentiles by nearest rank: the element at ceil(p * n). Ranked over distinct values with counts, so a hot key stays small."""
    per = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(value))
    n = F.sum("c").over(Window.partitionBy(*keys))
    per = per.withColumns({"upto": upto, "n": n})
    return per.groupBy(*keys).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))), F.col(value))).alias(f"p{round(p * 100)}") for p in shares))


def holm(tests: DataFrame, family: list[str], p: str, name: str) -> DataFrame:
    """Step-down adjusted p values within each family."""
    w = Window.partitionBy(*family).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return tests.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def win_tie_loss(d: DataFrame, keys: list[str], delta: str, tolerance: float = 1e-12) -> DataFrame:
    x = F.col(delta)
    one = lambda c: F.sum(c.cast("int"))
    return d.groupBy(*keys).agg(one(x > tolerance).alias("wins"), one(F.abs(x) <= tolerance).alias("ties"), one(x < -tolerance).alias("losses"))


def cost_index(rows: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """(keys, calls, tokens, unknown): calls of a slice, their known tokens, and calls whose usage isn't known."""
    return rows.groupBy(*keys).agg(F.count("*").alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"), F.sum(F.col(tokens).isNull().cast("int")).alias("unknown"))


def phase_costs(ledger: DataFrame, phase: str, identity: list[str], order: str) -> DataFrame:
    """Per phase and in all: identities, physical rows, identities resolved and not by their last row, and the attempts of those rows."""
    last = ledger.groupBy(phase, *identity).agg(F.max_by(F.struct("status", "attempts"), order).alias("z"), F.count("*").alias("n"))
    ok = F.coalesce(F.col("z.status") == "success", F.lit(False)).cast("int")
    per = last.groupBy(phase).agg(F.count("*").alias("identities"), F.sum("n").alias("physical_rows"), F.sum(ok).alias("resolved"), F.sum(1 - ok).alias("unresolved"), F.sum("z.attempts").alias("attempts"))
    names = ["identities", "physical_rows", "resolved", "unresolved", "attempts"]
    return per.withColumn(phase, F.coalesce(phase, F.lit("none"))).unionByName(per.agg(*(F.sum(n).alias(n) for n in names)).select(F.lit("TOTAL").alias(phase), *names))


def arm_costs(ledger: DataFrame, keys: list[str], physical: str, order: str, attempts: str, cells: str) -> DataFrame:
    """(keys, physical, attempts, logical_cells): requests charged once, by their first row, and the cells that they stand for."""
    size = F.greatest(F.lit(0), F.coalesce(F.size(cells), F.lit(0)))
    per = ledger.groupBy(*keys, physical).agg(F.min_by(attempts, order).alias("_a"), F.min_by(size, order).alias("_c"))
    return per.groupBy(*keys).agg(F.count("*").alias("physical"), F.sum("_a").alias("attempts"), F.sum("_c").alias("logical_cells"))


def interference(cells: DataFrame, keys: list[str], alone: Column, grouped: Column) -> DataFrame:
    """Accuracies alone and in groups, and the cells that groups rescue or spoil."""
    i = lambda c: c.cast("int")
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(i(alone)), 9).alias("singleton_accuracy"), F.round(F.avg(i(grouped)), 9).alias("group_accuracy"), F.sum(i(grouped & ~alone)).alias("rescued"), F.sum(i(alone & ~grouped)).alias("interfered"))


def membership_audit(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Least, median and largest number of queries that hold a cell, and the share of cells that some group holds."""
    per = actions.select(*keys, F.explode("cell_ids").alias("cell_id"), "size").groupBy(*keys, "cell_id").agg(F.count("*").alias("n"), F.max("size").alias("s"))
    return per.groupBy(*keys).agg(F.count("*").alias("cells"), F.min("n").alias("min_memberships"), F.percentile("n", 0.5).alias("median_memberships"), F.max("n").alias("max_memberships"), F.round(F.avg((F.col("s") > 1).cast("int")), 8).alias("group_coverage"))


def result_order(budget: str = "budget_share") -> list[Column]:
    """The order in which results are shown: by series, data sets before micro before macro, no budget before any."""
    scope = F.when(F.col("scope") == "dataset", 0).when(F.col("scope") == "micro", 1).otherwise(2)
    return [F.col("method_name"), F.col("scenario"), F.col("backend"), F.coalesce(F.col(budget), F.lit(-1.0)), F.col("group_size_variant"), scope, F.col("suite"), F.col("dataset")]


def near_budget(share: Column, wanted: float | None, tolerance: float = 1e-12) -> Column:
    """Whether a share is the wanted one, null being the wanted one where none is."""
    return share.isNull() if wanted is None else F.coalesce(F.abs(share - wanted) <= tolerance, F.lit(False))


def budget_label(share: Column) -> Column:
    """A share as 05pct, 20pct; none where there is none."""
    return F.when(share.isNull(), "none").otherwise(F.format_string("%02dpct", F.round(share * 100).cast("int")))
