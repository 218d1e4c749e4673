"""Files of a repair data set: CSV and JSON lines, manifests, rule registries, ledgers to append to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.functions.scalars import normalize_value
from cellmend.session import Stages


def read_csv(spark: SparkSession, path: str, normalize: bool = True, row: str | None = "row_idx", multi_line: bool = True) -> DataFrame:
    """All columns as texts, no value taken for a null, a byte order mark ignored, values normalised.

    `row` gets the position of each line. It is exact for one file; of several files it is the order of
    their names. Positions come from counts per input partition, not from sorting all rows in one task.
    multi_line: values may hold line feeds, for which a file is read by one task; without it, files are cut.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "\0").csv(path)
    names = [c.lstrip("﻿") for c in raw.columns]
    df = raw.toDF(*names)
    df = df.select(*((normalize_value(F.col(f"`{c}`")) if normalize else F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in names))
    return with_positions(df, row) if row else df


def with_positions(df: DataFrame, name: str) -> DataFrame:
    """Dense positions in the order of partitions: the offset of a partition is the sum of the counts before it."""
    tagged = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    tagged = Stages(df.sparkSession, "positions").keep(tagged)  # numbers are given once
    counts = tagged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_low"))
    # one row per input partition
    offsets = counts.select("_part", "_low", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_offset"))
    return tagged.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_offset") + F.col("_at") - F.col("_low")).cast("int")).drop("_part", "_at", "_low", "_offset")


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """One object per line. Lines that are no object stop a strict read and are skipped by a lenient one; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*wanted.fields, T.StructField("_bad", T.StringType())])
    read = lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    bad = F.col("r._bad").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    if strict:
        read = read.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("not an object: "), F.left("value", F.lit(80))))).otherwise(F.col("r")))
    else:
        read = read.where(~bad)
    return read.select("r.*").select(*wanted.fieldNames())


def _replace(spark: SparkSession, new: str, path: str) -> None:
    """Puts a written folder in the place of another, which goes once the new one stands."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files, old = at(path).getFileSystem(conf), at(f"{path.rstrip('/')}.old")
    files.delete(old, True)
    if files.exists(at(path)) and not files.rename(at(path), old):
        raise OSError(f"{path} can't be moved")
    if not files.rename(at(new), at(path)):
        raise OSError(f"{new} can't take the place of {path}")
    files.delete(old, True)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Whole or not at all, columns in sorted order: what stood there before stands until the new lines are written."""
    new = f"{path.rstrip('/')}.new"
    df.select(*sorted(df.columns)).write.mode("overwrite").json(new)
    _replace(df.sparkSession, new, path)


def append_ledger(df: DataFrame, path: str, batch: str) -> None:
    """Adds rows with their batch and a row_index that goes on from the largest one in the ledger."""
    from pyspark.errors import AnalysisException

    try:
        last = df.sparkSession.read.parquet(path).agg(F.max("row_index")).first()[0]
    except AnalysisException:  # there is none yet
        last = None
    numbered = with_positions(df, "_position").withColumn("row_index", F.col("_position").cast("long") + ((last if last is not None else -1) + 1)).drop("_position")
    numbered.withColumn("batch_id", F.lit(batch)).write.mode("append").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder. Empty files, which the reader passes over, come from its list of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string").select(plain("path").alias("path"))
    held = files.select(plain("path").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return listed.join(held, "path", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"))


def manifest_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files that lack on either side or differ in size or digest."""
    a, b = expected.alias("e"), actual.alias("a")
    both = a.join(b, F.col("e.path") == F.col("a.path"), "full_outer")
    state = F.when(F.col("a.path").isNull(), "missing").when(F.col("e.path").isNull(), "extra").when(F.col("e.bytes") != F.col("a.bytes"), "size").when(F.col("e.sha256") != F.col("a.sha256"), "content")
    return both.select(F.coalesce("e.path", "a.path").alias("path"), state.alias("state")).where("state is not null")


def is_portable(path: Column) -> Column:
    return ~path.rlike(r"^(/|[A-Za-z]:[\\/]|\\\\|~)") & ~path.rlike(r"(^|[\\/])\.\.([\\/]|$)")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, rule_id, determinant, dependent) of a registry {data set: [{rule_id, determinant, dependent}]}.

    A determinant may be one name or a list. Rules without a determinant or dependent, or whose
    dependent is among the determinants, are refused.
    """
    shape = "map<string, array<struct<rule_id:string, determinant:string, dependent:string>>>"
    text = spark.read.option("wholetext", True).text(path)
    each = text.select(F.explode(F.from_json("value", shape)).alias("dataset", "rules")).select("dataset", F.posexplode("rules").alias("at", "r"))
    names = F.when(F.col("r.determinant").startswith("["), F.from_json("r.determinant", "array<string>")).otherwise(F.array("r.determinant"))
    each = each.select("dataset", F.coalesce("r.rule_id", F.concat("dataset", F.lit("_fd"), (F.col("at") + 1).cast("string"))).alias("rule_id"), names.alias("determinant"), F.col("r.dependent").alias("dependent"))
    wrong = F.col("dependent").isNull() | (F.size(F.filter("determinant", lambda x: x.isNull() | (x == ""))) > 0) | F.array_contains("determinant", F.col("dependent"))
    return each.withColumn("dependent", F.when(wrong, F.raise_error(F.concat(F.lit("not a rule: "), F.col("rule_id")))).otherwise(F.col("dependent")))


#: statuses of an answer that isn't asked for again
SUCCESS = ["success", "ok", "completed"]
Fetch = Callable[[list[dict]], list[dict]]


def ask(requests: DataFrame, schema: str, fetch: Fetch, concurrency: int = 4, chunk: int = 100) -> DataFrame:
    """Sends requests through a client in `concurrency` partitions, a chunk at a time. Nothing here opens a network connection: offline, fetch looks answers up."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for start in range(0, len(pdf), chunk):
                yield pd.DataFrame(fetch(pdf.iloc[start : start + chunk].to_dict("records")))

    return requests.repartition(concurrency).mapInPandas(run, schema)


class ModelMismatch(RuntimeError):
    """An answer of another model than was asked."""


def ask_until_answered(
    requests: DataFrame, ledger: str, schema: str, fetch: Fetch, identity: list[str], attempts: int = 6, concurrency: int = 4, chunk: int = 100, backoff: float = 1.0, model: str | None = None, planned: str | None = None, cap: int | None = None
) -> DataFrame:
    """Asks what the ledger has no success for, and appends every answer to it; gives the ledger.

    schema: what fetch gives for each request: identity, status, and further columns; `attempts` is added.
    A request that fails is sent again up to `attempts` times, after a pause that doubles. What is in the
    ledger isn't asked again, so a run that was stopped goes on. Identities that are asked twice are asked
    once. model: answers that name another one in `model_returned` stop the run. planned, cap: the run is
    refused where the planned tokens of what is still to ask, on every attempt, go beyond the cap.
    """
    import time

    from cellmend.operators.ledger import still_to_ask
    from cellmend.operators.replay import reserve

    spark = requests.sparkSession
    exists = _exists(spark, ledger)
    once = requests.dropDuplicates(identity)
    todo = still_to_ask(once, spark.read.parquet(ledger), identity) if exists else once
    todo = Stages(spark, "ask").keep(todo)
    if planned and cap is not None:
        reserve(0, int(todo.agg(F.sum(planned)).first()[0] or 0), cap, attempts)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for start in range(0, len(pdf), chunk):
                left, done, turn = pdf.iloc[start : start + chunk].to_dict("records"), [], 0
                while left:
                    turn += 1
                    answers = fetch(left)
                    if model is not None and any(a.get("status") in SUCCESS and a.get("model_returned", model) != model for a in answers):
                        raise ModelMismatch(f"an answer isn't {model}'s")
                    failed = {tuple(a[c] for c in identity) for a in answers if a.get("status") not in SUCCESS} if turn < attempts else set()
                    done += [a | {"attempts": turn} for a in answers if tuple(a[c] for c in identity) not in failed]
                    left = [r for r in left if tuple(r[c] for c in identity) in failed]
                    if left:
                        time.sleep(backoff * 2 ** (turn - 1))
                yield pd.DataFrame(done)

    if not todo.isEmpty():
        todo.repartition(concurrency).mapInPandas(run, f"{schema}, attempts int").write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger) if exists or _exists(spark, ledger) else spark.createDataFrame([], f"{schema}, attempts int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
