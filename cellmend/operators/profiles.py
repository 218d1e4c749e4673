"""Column profiles, dominant types and formats, and rows that resemble a target."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmend.functions.scalars import bounded, format_signature, value_type
from cellmend.operators.grouping import numbered
from cellmend.session import Stages, broadcast_if_small

NUMERIC = r"^[\s]*[+-]?(\d+(_?\d)*\.?(\d+(_?\d)*)?|\.\d+(_?\d)*)([eE][+-]?\d+)?[\s]*$|^[\s]*[+-]?(?i:inf|infinity|nan)[\s]*$"


def ranked_values(values: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values per key with their counts, ties in the order of the values. Counted before ranked."""
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def column_profile(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows, nonempty and distinct values, missing and numeric share per column, over values cut to 160 characters."""
    v = bounded(F.col(value))
    per = values.groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("n"))
    number = F.regexp_replace("_v", ",", "").rlike(NUMERIC)
    full = F.col("_v") != ""
    p = per.groupBy(*keys).agg(F.sum("n").alias("rows_examined"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("nonempty_count"), F.sum(full.cast("long")).alias("unique_nonempty_count"), F.sum(F.when(full & number, F.col("n")).otherwise(0)).alias("numeric"))
    return p.select(
        *keys, "rows_examined", "nonempty_count", "unique_nonempty_count", F.round(1 - F.col("nonempty_count") / F.col("rows_examined"), 6).alias("missing_fraction"),
        F.when(F.col("nonempty_count") > 0, F.round(F.col("numeric") / F.col("nonempty_count"), 6)).otherwise(0.0).alias("numeric_fraction"),
    )


def dominant(values: DataFrame, keys: list[str], value: str, row: str) -> DataFrame:
    """(keys, dominant_type, dominant_format, empty_share): of equally frequent ones, the first in row order."""
    full = F.col(value) != ""
    base = values.groupBy(*keys).agg(F.avg((~full).cast("double")).alias("empty_share"))
    out = base
    for name, of in (("dominant_type", value_type), ("dominant_format", format_signature)):
        per = values.where(full).groupBy(*keys, of(F.col(value)).alias(name)).agg(F.count("*").alias("c"), F.min(row).alias("first"))
        out = out.join(per.groupBy(*keys).agg(F.max_by(name, F.struct("c", -F.col("first"))).alias(name)), keys, "left")
    return out.fillna({"dominant_type": "empty", "dominant_format": "EMPTY"})


#: columns up to which agreeing combinations are looked up; wider tables are compared in blocks
COMBINED = 5
TARGET_BLOCK, ROW_BLOCK = 256, 4096
#: blocks of targets that are broadcast, about 25 MB at 20 columns
BROADCAST_BLOCKS = 512


def similar_rows(table: DataFrame, targets: DataFrame, found: DataFrame, row: str, columns: list[str], k: int = 3) -> DataFrame:
    """(cell_id, similar_row, matches, rank): the k rows that agree with a target's row in most columns, then first in order.

    Columns known to be wrong in either row, and the target's own column, don't count; rows that are
    wrong in the target's column are left out. Narrow tables look up the combinations of agreeing columns,
    whose number depends on the columns alone; wide ones compare the targets with all rows in blocks.
    """
    flags = found.groupBy("row_idx").agg(F.collect_set("col_idx").alias("bad"))
    wide = table.select(F.col(row).alias("row_idx"), *(bounded(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns)).join(flags, "row_idx", "left")
    wide = wide.withColumn("bad", F.coalesce("bad", F.array().cast("array<int>")))
    best = _by_combinations(wide, targets, columns, k) if len(columns) <= COMBINED else _in_blocks(wide, targets, columns, k)
    order = Window.partitionBy("cell_id").orderBy(F.desc("matches"), "similar_row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _by_combinations(wide: DataFrame, targets: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Each combination of agreeing columns keeps its k + 1 first rows per value and target column: a row among the k best is among those of the combination of all columns in which it agrees."""
    candidates = None
    for i, own in enumerate(columns):
        others = [j for j in range(len(columns)) if j != i]
        peers = wide.where(~F.array_contains("bad", i))
        wanted = targets.where(F.col("col_idx") == i).select("cell_id", "row_idx").join(wide, "row_idx")
        for size in range(1, len(others) + 1):
            for some in combinations(others, size):
                names = [columns[j] for j in some]
                sound = lambda: ~F.arrays_overlap("bad", F.array(*map(F.lit, some)))  # noqa: E731, B023
                # the k + 1 smallest rows: aggregated in parts, never a whole group in one place
                first = peers.where(sound()).select(*names, F.col("row_idx").alias("r")).withColumn("slot", F.pmod(F.xxhash64("r"), F.lit(64)))
                part = Window.partitionBy(*names, "slot").orderBy("r")
                first = first.withColumn("n", F.row_number().over(part)).where(F.col("n") <= k + 1)
                first = first.groupBy(*names).agg(F.slice(F.sort_array(F.collect_list("r")), 1, k + 1).alias("rs"))
                hit = wanted.where(sound()).join(first, names).select("cell_id", "row_idx", F.explode("rs").alias("similar_row"), F.lit(size).alias("matches"))
                candidates = hit if candidates is None else candidates.unionByName(hit)
    return candidates.where("similar_row <> row_idx").groupBy("cell_id", "similar_row").agg(F.max("matches").cast("long").alias("matches"))


def _in_blocks(wide: DataFrame, targets: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The targets against all rows, 64-bit hashes of values compared block by block; a block of rows sends on its k best of each target."""
    spark = wide.sparkSession
    # a column that is wrong agrees with none: on the one side it has the number of its row, on the other its negative
    hashes = lambda sign: F.array(*(F.when(F.array_contains("bad", i), F.lit(sign) * F.col("row_idx") - sign).otherwise(F.xxhash64(F.lit(i), c)) for i, c in enumerate(columns)))
    item = lambda df, sign, *more: df.select("row_idx", hashes(sign).alias("v"), "bad", *more)
    own = numbered(spark, item(targets.select("cell_id", "row_idx", "col_idx").join(wide, "row_idx"), 1, "cell_id", "col_idx"), ["cell_id"], "n")
    peers = numbered(spark, item(wide, -1), ["row_idx"], "n")
    blocks = lambda df, size, *names: df.groupBy(F.floor(F.col("n") / size).alias("block")).agg(F.collect_list(F.struct("row_idx", "v", "bad", *names)).alias("items"))
    asked = Stages(spark, "similar").keep(blocks(own, TARGET_BLOCK, "cell_id", "col_idx"))
    rows = blocks(peers, ROW_BLOCK).select(F.col("items").alias("rows"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, asked.count() - 1)).cast("long"))).alias("block"))

    def run(batches):
        for pdf in batches:
            for some, many in zip(pdf["items"], pdf["rows"]):
                t, r = (np.array([x["v"] for x in part], dtype=np.int64) for part in (some, many))
                at, col = np.array([x["row_idx"] for x in some]), np.array([x["col_idx"] for x in some])
                where = np.array([x["row_idx"] for x in many])
                wrong = np.zeros((len(many), len(columns)), dtype=bool)
                for i, x in enumerate(many):
                    wrong[i, list(x["bad"])] = True
                n = np.zeros((len(some), len(many)), dtype=np.int16)
                for c in range(len(columns)):
                    n += (t[:, c][:, None] == r[:, c][None, :]) & (col != c)[:, None]
                n[wrong[:, col].T | (at[:, None] == where[None, :])] = 0
                order = np.lexsort((np.broadcast_to(where, n.shape), -n))[:, :k]
                i, j = np.repeat(np.arange(len(some)), order.shape[1]), order.ravel()
                keep = n[i, j] > 0
                yield pd.DataFrame({"cell_id": [some[x]["cell_id"] for x in i[keep]], "similar_row": where[j[keep]].astype(np.int32), "matches": n[i[keep], j[keep]].astype(np.int64)})

    # the blocks of rows stay where they were made; those of targets come to them, by broadcast if they are counted as few
    return rows.join(broadcast_if_small(asked, BROADCAST_BLOCKS), "block").mapInPandas(run, "cell_id string, similar_row int, matches long")
