"""Answers that arrive as files, taken into a ledger once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cellmend.operators.replay import reserve


class Drift(RuntimeError):
    """A row whose identity isn't that of an earlier row of its key."""


#: folders that a batch's keys are spread over, so that a batch reads what it may meet again of the ledger only once
SLOTS = 16


def ingest(
    spark: SparkSession, source: str, schema, ledger: str, checkpoint: str, keys: list[str], order: str, identity: list[str] | None = None, tokens: str | None = None, cap: int | None = None, files: int = 4
) -> StreamingQuery:
    """Reads all files there are, a batch at a time, and appends rows whose key isn't in the ledger yet.

    Of rows of one key within a batch the first by `order` is taken. A batch that is run again writes its
    folder again, so a lost executor or a restart leaves no second copy. Earlier rows are compared by keys
    and identity alone, of those slots only that the batch's keys fall into.

    identity: columns that all rows of a key must share; a row that doesn't stops the stream with Drift.
    tokens, cap: the stream stops before a batch whose tokens would take the ledger above the cap.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    told = [*keys, *(identity or [])]

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_slot", slot).persist()
        try:
            rest = [c for c in batch.columns if c not in keys]
            first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*batch.columns)
            known = None
            if number:
                met = [r[0] for r in batch.select("_slot").distinct().collect()]  # SLOTS at most
                earlier = spark.read.option("basePath", ledger).schema(written(batch)).parquet(ledger).where((F.col("batch") < number) & F.col("_slot").isin(met))
                known = earlier.select(*told, *([tokens] if tokens else []))
            if identity:
                all_ = batch.select(*told) if known is None else batch.select(*told).unionByName(known.select(*told))
                several = all_.groupBy(*keys).agg(F.countDistinct(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in identity))).alias("n")).where("n > 1")
                strange = several.first()
                if strange is not None:
                    raise Drift(f"another identity under {[strange[k] for k in keys]}")
            if known is not None:
                first = first.join(known.select(*keys).distinct(), keys, "left_anti")
            if tokens and cap is not None:
                spent = spark.read.option("basePath", ledger).schema(written(batch)).parquet(ledger).where(F.col("batch") < number).agg(F.sum(tokens)).first()[0] if number else 0
                reserve(int(spent or 0), int(first.agg(F.sum(tokens)).first()[0] or 0), cap, 1)
            first.write.mode("overwrite").partitionBy("_slot").parquet(f"{ledger}/batch={number}")
        finally:
            batch.unpersist()

    def written(batch: DataFrame):
        return T.StructType([*batch.schema.fields, T.StructField("batch", T.IntegerType())])

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Each key once, state being dropped once the watermark has passed it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
