"""Cells of a dirty and a clean table: differences, ids, masks, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmend.functions.scalars import cell_id

TARGET_MASK = "<TARGET_ERROR_MASKED>"
OTHER_MASK = "<OTHER_DETECTED_ERROR_MASKED>"
# fixed values: fields that selection must not see
ORACLE_FIELDS = ["baran_correct", "clean", "clean_path", "clean_value", "constraint", "correct_repair", "error_type", "error_value", "llm_correct", "missing_value", "right_value", "tuple_pairs"]
# fixed values: columns that may hold a row's own id, in order of preference
ROW_ID_COLUMNS = ["row_id", "tuple_id", "index", "id"]


def unpivot(table: DataFrame, row: str, columns: list[str], value: str) -> DataFrame:
    """(row, col_idx, column_name, value) in long form, columns by position; nulls as empty texts."""
    items = [F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias(value)) for i, c in enumerate(columns)]
    return table.select(F.col(row).alias("row_idx"), F.inline(F.array(*items)))


def cell_pairs(dirty: DataFrame, clean: DataFrame, row: str, columns: list[str], suite: str, dataset: str, clean_columns: list[str] | None = None) -> DataFrame:
    """All cells of rows that both tables hold, with their dirty and clean value; `unpaired_rows` gives the others.

    Columns meet by position, so the clean ones may have other names.
    """
    names = clean_columns or columns
    both = dirty.select(F.col(row).alias("row_idx"), F.struct(*columns).alias("d")).join(clean.select(F.col(row).alias("row_idx"), F.struct(*names).alias("c")), "row_idx")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    items = [F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("column_name"), text(F.col("d")[c]).alias("dirty_value"), text(F.col("c")[n]).alias("clean_value")) for i, (c, n) in enumerate(zip(columns, names))]
    cells = both.select(F.lit(suite).alias("suite"), F.lit(dataset).alias("dataset"), "row_idx", F.inline(F.array(*items)))
    return cells.withColumn("cell_id", cell_id(F.col("suite"), F.col("dataset"), F.col("row_idx"), F.col("col_idx")))


def unpaired_rows(dirty: DataFrame, clean: DataFrame, row: str) -> DataFrame:
    """(row_idx, held_by): rows that only the dirty or only the clean table holds. Two tables that pair up give none."""
    side = lambda df, name: df.select(F.col(row).alias("row_idx")).distinct().withColumn(name, F.lit(True))
    both = side(dirty, "d").join(side(clean, "c"), "row_idx", "full_outer").where("d is null or c is null")
    return both.select("row_idx", F.when(F.col("c").isNull(), "dirty").otherwise("clean").alias("held_by"))


def errors(pairs: DataFrame) -> DataFrame:
    """Cells whose two values are not the same string."""
    return pairs.where("dirty_value <> clean_value")


def online_view(cells: DataFrame) -> DataFrame:
    """The cells without anything that tells the right value."""
    return cells.drop(*ORACLE_FIELDS)


def row_id(table: DataFrame, row: str):
    """The table's own row id, the first column of ROW_ID_COLUMNS that it has, else its row position."""
    own = next((c for c in ROW_ID_COLUMNS if c in table.columns), row)
    return F.col(own).cast("string")


def masked_rows(dirty: DataFrame, found: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(cell_id, masked): the row of each error cell as `column=value` parts, the cell itself and other errors of its row masked."""
    flags = found.groupBy("row_idx").agg(F.collect_set("col_idx").alias("bad"))  # at most one element a column
    parts = [
        F.concat(F.lit(f"{c}="), F.when(F.col("col_idx") == i, TARGET_MASK).when(F.array_contains("bad", i), OTHER_MASK).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))))
        for i, c in enumerate(columns)
    ]
    rows = dirty.select(F.col(row).alias("row_idx"), *columns).join(flags, "row_idx")
    return found.select("cell_id", "row_idx", "col_idx").join(rows, "row_idx").select("cell_id", F.concat_ws(" | ", *parts).alias("masked"))


def annotate(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Cells with what the error log says of them; of several entries of a cell the last one (by log_id) counts."""
    row = F.col("row_id").try_cast("int")
    last = log.select("dataset", row.alias("row_idx"), "column_name", F.struct("log_id", "error_type", "right_value", "missing_value").alias("e")).where("row_idx is not null")
    last = last.groupBy("dataset", "row_idx", "column_name").agg(F.max_by("e", "e.log_id").alias("e"))
    return cells.join(last, ["dataset", "row_idx", "column_name"], "left").select("*", "e.error_type", "e.right_value", "e.missing_value").drop("e")
