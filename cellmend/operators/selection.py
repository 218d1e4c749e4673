"""Choice of queries under a budget: the gain of a set is, per cell, the largest gain of the queries that cover it."""

from __future__ import annotations

import heapq
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def objective_value(pairs: DataFrame, keys: list[str], cell: str = "cell_id", gain: str = "gain_units") -> DataFrame:
    """Sum over cells of the largest gain, never below 0, of the chosen pairs."""
    best = pairs.groupBy(*keys, cell).agg(F.greatest(F.lit(0), F.max(gain)).alias("b"))
    return best.groupBy(*keys).agg(F.sum("b").alias("objective_units"), F.count("*").alias("covered_cells"))


def _marginal(gains: dict[str, int], best: dict[str, int]) -> int:
    return sum(g - best.get(c, 0) for c, g in gains.items() if g > best.get(c, 0))


def _take(gains: dict[str, int], best: dict[str, int]) -> None:
    for c, g in gains.items():
        if g > best.get(c, 0):
            best[c] = g


def greedy(pairs: dict[str, dict[str, int]], costs: dict[str, int], budget: int, lazy: bool = True) -> tuple[list[tuple[str, int]], int, str]:
    """(steps (query, gain), units, rule). Exact whole numbers; ties go to the smaller query id.

    lazy keeps stale gains as upper bounds and refreshes the best one only; without it every gain is taken
    anew in each step. In the end the best single affordable query replaces the set if it gains more, or
    as much for less, or as much for as much with the smaller id.
    """
    best: dict[str, int] = {}
    steps, spent = [], 0
    order = lambda q: (-Fraction(_marginal(pairs[q], best), costs[q]), q)
    queue = [order(q) for q in sorted(pairs)]
    heapq.heapify(queue)
    while queue:
        if not lazy:
            queue = [order(q) for _, q in queue]
            heapq.heapify(queue)
        _, q = heapq.heappop(queue)
        if spent + costs[q] > budget:
            continue
        fresh = order(q)
        if fresh[0] == 0:
            continue
        if queue and queue[0] < fresh:
            heapq.heappush(queue, fresh)
            continue
        steps.append((q, _marginal(pairs[q], best)))
        spent += costs[q]
        _take(pairs[q], best)
    units = sum(best.values())
    single = min(((-_marginal(pairs[q], {}), costs[q], [q]) for q in pairs if costs[q] <= budget), default=None)
    if single and single < (-units, spent, sorted(q for q, _ in steps)):
        return [(single[2][0], -single[0])], -single[0], "best_single"
    return steps, units, "greedy"


def exhaustive(pairs: dict[str, dict[str, int]], costs: dict[str, int], budget: int) -> int:
    """The best value of any affordable set, for 22 queries at most; a check for the greedy choice."""
    if len(pairs) > 22:
        raise ValueError("more than 22 queries")
    top = 0
    for k in range(len(pairs) + 1):
        for some in combinations(sorted(pairs), k):
            if sum(costs[q] for q in some) <= budget:
                best: dict[str, int] = {}
                for q in some:
                    _take(pairs[q], best)
                top = max(top, sum(best.values()))
    return top


def select_queries(pairs: DataFrame, slices: list[str], budget: str = "budget") -> DataFrame:
    """(slices..., step, query_id, query_cost, gain_units, rule) of each slice.

    pairs has the slice columns, query_id, cell_id, gain_units (whole numbers), query_cost and the
    slice's budget. Slices (a data set, a back end, a variant, a budget share) are independent and are
    chosen in parallel; within one the choice is sequential by nature and its pairs must fit a task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in slices), "step int, query_id string, query_cost bigint, gain_units decimal(38,0), rule string"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gains: dict[str, dict[str, int]] = defaultdict(dict)
        costs: dict[str, int] = {}
        for q, c, g, cost in zip(pdf.query_id, pdf.cell_id, pdf.gain_units, pdf.query_cost):
            gains[q][c] = max(int(g), gains[q].get(c, 0))
            costs[q] = int(cost)
        steps, _, rule = greedy(gains, costs, int(pdf[budget].iloc[0]))
        key = list(pdf[slices].iloc[0])
        return pd.DataFrame([[*key, i, q, costs[q], g, rule] for i, (q, g) in enumerate(steps)], columns=[*slices, "step", "query_id", "query_cost", "gain_units", "rule"])

    return pairs.groupBy(*slices).applyInPandas(run, schema)


def representative(pairs: dict[str, dict[str, int]], limit: int) -> list[str]:
    """Up to `limit` queries rich in overlap: the largest first, then by id one that shares a cell with those chosen, or else the next one."""
    left = sorted(pairs, key=lambda q: (-len(pairs[q]), q))[:1]
    chosen, covered, rest = list(left), {c for q in left for c in pairs[q]}, sorted(set(pairs) - set(left))
    while rest and len(chosen) < limit:
        q = next((q for q in rest if not covered.isdisjoint(pairs[q])), rest[0])
        chosen.append(q)
        rest.remove(q)
        covered |= set(pairs[q])
    return chosen


# fixed value: the share of the optimum that the greedy choice is known to reach
FLOOR = 0.405


def conformance(pairs: DataFrame, slices: list[str], sampled: int = 64, exact: int = 10) -> DataFrame:
    """(slices, queries, lazy_is_eager, ratio, ok): the greedy choice of every slice held against its eager form and, on a few queries, the optimum.

    Checked on up to `sampled` and `exact` overlapping queries under a fifth of their cost; the sizes are the feature.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in slices), "queries int, lazy_is_eager boolean, ratio double, ok boolean"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gains: dict[str, dict[str, int]] = defaultdict(dict)
        costs: dict[str, int] = {}
        for q, c, g, cost in zip(pdf.query_id, pdf.cell_id, pdf.gain_units, pdf.query_cost):
            gains[q][c] = max(int(g), gains[q].get(c, 0))
            costs[q] = int(cost)

        def part(n: int) -> tuple[dict, dict, int]:
            some = representative(gains, n)
            own, total = {q: costs[q] for q in some}, sum(costs[q] for q in some)
            return {q: gains[q] for q in some}, own, min(total, max(min(own.values()), total // 5))

        few = part(sampled)
        same = greedy(*few) == greedy(*few, lazy=False)
        tiny = part(exact)
        top = exhaustive(*tiny)
        ratio = greedy(*tiny)[1] / top if top else 1.0
        return pd.DataFrame([[*pdf[slices].iloc[0], len(gains), same, ratio, same and ratio >= FLOOR]], columns=[*slices, "queries", "lazy_is_eager", "ratio", "ok"])

    return pairs.groupBy(*slices).applyInPandas(run, schema)
