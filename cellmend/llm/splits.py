"""Splits that keep related records together, by grouped iterative stratification.

Groups are rows of label counts from the start. Groups with equal counts are a class, of which only the
number of members matters, so that all groups are placed against one another as rows of their classes.
The label with the fewest records still to place is next, its classes follow from the one with most of
that label, and their members go to the split that still needs most of it. That rule looks at one label
at a time; where it leaves a split too large or too small, groups change places until every split is as
near to its share as moving one group, or exchanging two, brings it, the labels deciding between equals.

Classes are exact whatever their number, so no result depends on the size of the input. What is held
grows with the rows of class and label. Which members of a class go where is decided by their rank in hash order.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.llm.components import hash_to_min
from cellmend.operators.grouping import ranks
from cellmend.session import Stages, broadcast_if_small

#: former sizes from which counts were rounded; tests set them, nothing reads them
HEAD = 4096
CLASS_ROWS = 200_000
#: classes times labels that are laid out as numbers at once
CLASS_CELLS = 2_000_000
#: a split this near to its share, or by half of the smallest group, is not changed for its size alone
NEAR = 0.002
# fixed values: words that name no family
NO_NAME = ["unknown", "n/a"]


def _dealt(need: np.ndarray, in_all: np.ndarray, each: float, members: int) -> np.ndarray:
    """How many of equal groups each split gets if one after the other goes to the split with the largest need."""
    out = np.zeros(need.size, dtype=np.int64)
    order = np.sort(need)[::-1]
    # the level to which the needs sink, of the splits that get any
    levels = (np.cumsum(order) - members * each) / np.arange(1, need.size + 1)
    level = levels[np.flatnonzero(order >= levels)[-1]]
    out = np.maximum(0, np.floor((need - level) / each)).astype(np.int64)
    while out.sum() > members:
        out[out.argmax()] -= 1
    for _ in range(members - int(out.sum())):
        left = need - out * each
        out[max(range(need.size), key=lambda s: (left[s], in_all[s], -s))] += 1
    return out


class Counts:
    """Counts above zero by class and label: entries in the order of classes."""

    def __init__(self, start: np.ndarray, label: np.ndarray, n: np.ndarray, labels: int):
        self.start, self.label, self.n, self.labels = start, label, n.astype(float), labels
        self.row = np.repeat(np.arange(start.size - 1), np.diff(start))
        self.size = np.bincount(self.row, weights=self.n, minlength=start.size - 1)

    @staticmethod
    def of(table: np.ndarray | Counts) -> Counts:
        if isinstance(table, Counts):
            return table
        row, label = np.nonzero(table)
        return Counts(np.searchsorted(row, np.arange(table.shape[0] + 1)), label, table[row, label], table.shape[1])

    def one(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        k = slice(self.start[c], self.start[c + 1])
        return self.label[k], self.n[k]

    def total(self, members: np.ndarray) -> np.ndarray:
        """Of each label, over so many members of each class."""
        return np.bincount(self.label, weights=members[self.row] * self.n, minlength=self.labels)

    def laid(self, classes: np.ndarray) -> np.ndarray:
        """(class, label) of a few classes."""
        classes, out = np.asarray(classes), np.zeros((len(classes), self.labels))
        many = self.start[classes + 1] - self.start[classes]
        at = np.repeat(self.start[classes] - np.cumsum(many) + many, many) + np.arange(many.sum())
        out[np.repeat(np.arange(len(classes)), many), self.label[at]] = self.n[at]
        return out


def place(counts: np.ndarray | Counts, members: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """(class, split): members of each class per split. counts: by class and label, of one member; shares: of the splits, the first of equals preferred."""
    counts = Counts.of(counts)
    left, size = counts.total(members), counts.size
    wanted = shares[:, None] * left[None, :]
    in_all = wanted.sum(axis=1)
    out, open_ = np.zeros((members.size, shares.size), dtype=np.int64), np.ones(members.size, dtype=bool)
    by = np.argsort(counts.label, kind="stable")
    ends = np.searchsorted(counts.label[by], np.arange(counts.labels + 1))
    queue = [(n, label) for label, n in enumerate(left) if n > 0]
    heapq.heapify(queue)
    while queue:
        n, label = heapq.heappop(queue)
        if n != left[label]:
            continue
        own = by[ends[label] : ends[label + 1]]
        own = own[open_[counts.row[own]]]
        having, each, changed = counts.row[own], counts.n[own], []
        for k in np.lexsort((having, -size[having], -each)):
            c = having[k]
            labels, numbers = counts.one(c)
            out[c] = _dealt(wanted[:, label], in_all, each[k], int(members[c]))
            wanted[:, labels] -= out[c][:, None] * numbers[None, :]
            in_all -= out[c] * size[c]
            left[labels] -= members[c] * numbers
            changed.append(labels)
        open_[having] = False
        left[label] = 0
        for other in np.unique(np.concatenate(changed)) if changed else ():
            if left[other] > 0:
                heapq.heappush(queue, (left[other], int(other)))
    return out


def settle(placed: np.ndarray, counts: np.ndarray | Counts, shares: np.ndarray) -> np.ndarray:
    """Changes places of groups until no move of one group and no exchange of two brings the splits nearer to their shares."""
    counts = Counts.of(counts)
    placed, size = placed.copy(), counts.size
    total, all_of = float(size @ placed.sum(axis=1)), counts.total(placed.sum(axis=1))
    if not total:
        return placed
    near = max(size[size > 0].min() / 2, NEAR * total)
    over = size @ placed - shares * total
    labels = np.stack([counts.total(own) for own in placed.T]) - shares[:, None] * all_of[None, :]
    weight = 1 / np.maximum(1, all_of)

    def far(dev):
        return np.maximum(0, np.abs(dev) - near) ** 2

    def off(a, b, gives, number, takes):
        """How far the labels of both splits are from their shares after each of the moves."""
        parts, step = [], max(1, CLASS_CELLS // counts.labels)
        for k in range(0, gives.size, step):
            shift = number[k : k + step, None] * counts.laid(gives[k : k + step]) - (0 if takes is None else counts.laid(takes[k : k + step]))
            parts.append(np.abs((labels[a] - shift) * weight).sum(axis=1) + np.abs((labels[b] + shift) * weight).sum(axis=1))
        return np.concatenate(parts)

    while True:
        best = (-1e-6, None)
        for a in np.argsort(-over)[:4]:
            for b in np.argsort(over)[:4]:
                if a == b or over[a] <= over[b]:
                    continue
                now, ideal = far(over[a]) + far(over[b]), (over[a] - over[b]) / 2
                there, back = np.flatnonzero(placed[:, a]), np.flatnonzero(placed[:, b])
                if not there.size or now == 0:
                    continue
                many = np.minimum(placed[there, a], np.maximum(1, np.floor(ideal / np.maximum(size[there], 1e-9)))).astype(np.int64)
                moved = many * size[there]
                options = [(far(over[a] - moved) + far(over[b] + moved) - now, there, many, None)]
                if back.size:
                    # of every group the one to exchange it for that comes nearest
                    back = back[np.argsort(size[back], kind="stable")]
                    at = np.clip(np.searchsorted(size[back], size[there] - ideal), 0, back.size - 1)
                    for k in (at, np.maximum(0, at - 1)):
                        moved = size[there] - size[back[k]]
                        options.append((far(over[a] - moved) + far(over[b] + moved) - now, there, np.ones(there.size, np.int64), back[k]))
                for gain, gives, number, takes in options:
                    ready = np.flatnonzero(gain <= gain.min() + 1e-9)
                    i = ready[0]
                    if gain[i] > best[0] + 1e-9:
                        continue
                    if ready.size > 1:
                        # of equals the one that suits the labels best
                        i = ready[off(a, b, gives[ready], number[ready], None if takes is None else takes[ready]).argmin()]
                    best = (gain[i], (a, b, gives[i], number[i], None if takes is None else takes[i]))
        if best[1] is None:
            return placed
        a, b, give, number, take = best[1]
        shift = number * counts.laid([give])[0]
        placed[give, a] -= number
        placed[give, b] += number
        if take is not None:
            shift = shift - counts.laid([take])[0]
            placed[take, b] -= 1
            placed[take, a] += 1
        labels[a] -= shift
        labels[b] += shift
        over[a] -= shift.sum()
        over[b] += shift.sum()


def _classes(stages: Stages, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups (g, class), classes (class, members, labels, ns)): groups of the same counts are a class, whatever their number."""
    per = counts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("v"))  # a label once each
    per = stages.keep(per.withColumn("class", F.sha2(F.to_json(F.struct("v")), 256)))
    classes = per.groupBy("class").agg(F.count("*").alias("members"), F.min("v").alias("v"))
    return per.select("g", "class"), classes.select("class", "members", F.col("v.label").alias("labels"), F.col("v.n").alias("ns"))


def stratified(spark: SparkSession, records: DataFrame, group: str, label: str, targets: dict[str, float]) -> DataFrame:
    """(group, split): a split for every group, the shares of `targets` being met as well as whole groups allow.

    Null labels are a label of their own; records with a null group get no row. Shares are taken in
    proportion to their sum.
    """
    splits, whole = sorted(targets, key=lambda s: (-targets[s], s)), sum(targets.values())
    shares = np.array([targets[s] / whole for s in splits])
    stages = Stages(spark, "splits")
    counts = records.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.coalesce(F.col(label).cast("string"), F.lit("\0")).alias("label")).agg(F.count("*").alias("n"))
    counts = stages.keep(counts)
    groups, classes = _classes(stages, counts)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class")
        which, labels = pd.factorize(np.concatenate(pdf["labels"].to_list()), sort=True)
        start = np.concatenate([[0], pdf["ns"].map(len).to_numpy().cumsum()])
        table = Counts(start, which, np.concatenate(pdf["ns"].to_list()), labels.size)
        placed = settle(place(table, pdf["members"].to_numpy(), shares), table, shares)
        return pd.DataFrame({"class": pdf["class"].to_numpy(), "upto": list(placed.cumsum(axis=1))}, columns=["class", "upto"])

    # one task, over all classes, as the rule places each after the others
    plan = stages.keep(classes.groupBy(F.lit(0).alias("all")).applyInPandas(choose, "class string, upto array<long>"))
    ranked = ranks(spark, groups.join(broadcast_if_small(plan), "class").withColumn("_h", F.xxhash64("g")), ["class"], ["_h", "g"])
    names = F.array(*map(F.lit, splits))
    return ranked.select(F.col("g").alias(group), F.element_at(names, F.size(F.filter("upto", lambda u: u < F.col("rank"))) + 1).alias("split"))


def canonical_name(name: Column) -> Column:
    """Trimmed and in lower case; null where nothing is left."""
    name = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    return F.when(name != "", name)


def tied_names(spark: SparkSession, ties: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(dataset, group_dataset): the smallest data set tied to each by shared families, in the tables of `ties` (table, data set column, family column)."""
    edges = None
    for df, dataset, family in ties:
        name = canonical_name(F.col(family))
        pair = df.select(F.concat(F.lit("0"), canonical_name(F.col(dataset))).alias("a"), F.concat(F.lit("1"), F.when(~name.isin(*NO_NAME), name)).alias("b")).dropna().distinct()
        edges = pair if edges is None else edges.unionByName(pair)
    found = hash_to_min(spark, edges, "a", "b").where(F.col("vertex").startswith("0"))
    return found.select(F.substring("vertex", 2, 1 << 30).alias("dataset"), F.substring("component", 2, 1 << 30).alias("group_dataset"))


def split_records(spark: SparkSession, records: DataFrame, ties: list[tuple[DataFrame, str, str]], targets: DataFrame, cell: str = "cell_id", dataset: str = "dataset", label: str = "sample_stratum") -> DataFrame:
    """(cell_id, group_dataset, split), one row per distinct cell.

    A record without a data set belongs to the one its cell_id names; a cell under several names takes
    the smallest group. A data set without any family is a group by itself. `targets` has one row per
    split; a null name or share, and a share that isn't positive, name no split.
    """
    wanted = {r[0]: float(r[1]) for r in targets.where("target_share > 0 and split_name is not null").groupBy("split_name").agg(F.sum("target_share")).collect()}  # one row per split
    stages = Stages(spark, "split-records")
    name = F.coalesce(canonical_name(F.col(dataset)), canonical_name(F.regexp_extract(cell, r"^[^:]*:(.*):\d+:\d+$", 1)))
    cells = records.where(F.col(cell).isNotNull()).select(F.col(cell).alias("cell_id"), name.alias("_name"), F.col(label).alias("_label"))
    # the ties are written first: a table of their real size is broadcast if small, and else lets AQE split a data set with a third of the cells
    joined = cells.join(stages.keep(tied_names(spark, ties)).withColumnRenamed("dataset", "_name"), "_name", "left").withColumn("group_dataset", F.coalesce("group_dataset", "_name"))
    one = stages.keep(joined.groupBy("cell_id").agg(F.min("group_dataset").alias("group_dataset"), F.min("_label").alias("_label")))
    if not wanted:
        return one.select("cell_id", "group_dataset", F.lit(None).cast("string").alias("split"))
    return one.join(stratified(spark, one, "group_dataset", "_label", wanted), "group_dataset", "left").select("cell_id", "group_dataset", "split")
