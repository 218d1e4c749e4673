"""Messages delivered more than once.

The identifiers of each time bucket are stored once (time bucket, 128-bit identifier, count), a folder
per time bucket and a file per shard of identifiers. On its way there a shard passes one Bloom filter per
time bucket, in time order: an identifier that no earlier filter holds is definitely new there, and only
the time buckets whose filters hold it are noted beside it. Identifiers with a note, or that occur twice
within a bucket, are possible repeats; they are verified against the stored identifiers of the noted
buckets alone, and in the end by the identifiers themselves. The identifiers are shuffled once, into the
storage, and nothing else of a message that was delivered once ever moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.session import BROADCAST_ROWS, Stages, broadcast_if_small, shuffle_width

HASHES = 6
#: messages with more deliveries than this and than a thousandth of all, a thousand at most, are joined by broadcast
HOT_LEAST = 10_000
BITS_PER_ID = 16


def canonical_digest(value: Column) -> Column:
    """A hexadecimal digest in lower case, without outer blanks and without a leading algorithm name."""
    return F.regexp_replace(F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), r"^(?:[a-z][a-z0-9-]*:|0x)\s*", "")


class _Filter:
    """A Bloom filter of one time bucket's identifiers, sized by their number."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.size = np.uint64(1 << max(6, int(BITS_PER_ID * k1.size - 1).bit_length()))
        self.words = np.zeros(int(self.size) >> 6, dtype=np.uint64)
        for at in self._places(k1, k2):
            np.bitwise_or.at(self.words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))

    def _places(self, k1, k2):
        for i in range(HASHES):
            yield (k1 + np.uint64(i) * (k2 | np.uint64(1))) & (self.size - np.uint64(1))

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        out = np.ones(k1.size, dtype=bool)
        for at in self._places(k1, k2):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _summed(bucket: np.ndarray, k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row per (bucket, k1, k2), with the sum of n."""
    order = np.lexsort((k2, k1, bucket))
    bucket, k1, k2 = bucket[order], k1[order], k2[order]
    new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])][: k1.size])
    return bucket[new], k1[new], k2[new], np.add.reduceat(n[order], new) if new.size else n[:0]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, k1, k2) as counts, batch by batch, so that a message met often is shuffled as a few rows."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(c).to_numpy() for c in ("bucket", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summed(*columns, np.ones(batch.num_rows, np.int64))], names=["bucket", "k1", "k2", "n"])


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (bucket, k1, k2, n) of one shard, which come in time order, with the time buckets to verify each against."""
    filters: dict[int, _Filter] = {}
    held: list[tuple] = []
    now = None

    def close():
        k1, k2, n = (np.concatenate(c) for c in zip(*held))
        _, k1, k2, n = _summed(np.zeros(n.size, np.int64), k1, k2, n)
        own = n > 1
        hits = []
        for bucket, past in filters.items():
            hit = np.flatnonzero(past.holds(k1, k2))
            own[hit] = True
            hits.append((hit, np.full(hit.size, bucket)))
        filters[now] = _Filter(k1, k2)
        hits.append((np.flatnonzero(own), np.full(int(own.sum()), now)))
        row, bucket = (np.concatenate(c) for c in zip(*hits))
        order = np.argsort(row, kind="stable")
        offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=n.size))].astype(np.int32)
        noted = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket[order].astype(np.int64)))
        columns = [pa.array(np.full(n.size, now, np.int64)), pa.array(k1.astype(np.int64)), pa.array(k2.astype(np.int64)), pa.array(n.astype(np.int64)), noted]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "k1", "k2", "n", "noted"])

    for batch in batches:
        t = batch.column("bucket").to_numpy()
        columns = [batch.column(c).to_numpy().astype(np.uint64) for c in ("k1", "k2")] + [batch.column("n").to_numpy()]
        edges = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if t.size else []
        for start, end in zip(edges, [*edges[1:], t.size]):
            if held and t[start] != now:
                yield close()
                held.clear()
            now = int(t[start])
            held.append(tuple(c[start:end] for c in columns))
    if held:
        yield close()


class RepeatedDeliveries:
    """Finds the deliveries of a message beyond its first.

    identifiers: columns that name a message. A null or blank value of one in `blank_is_null` equals
    another null or blank; of the others null equals null only. Rows whose column `required` is null
    are never repeats. The first delivery has the earliest `received_at` (null counts as latest), then
    the smallest `delivery_id`; rows repeated under one delivery_id are one delivery, rows without one are
    not looked at. An empty table gives an empty result; columns beside those named play no part.

    buckets: the number of time buckets; by default as many as give the files of the storage about
    `ids_per_file` identifiers, 64 at most.
    """

    def __init__(self, spark: SparkSession, identifiers: list[str], required: str, blank_is_null: tuple[str, ...] = (), buckets: int | None = None, delivery: str = "delivery_id", received: str = "received_at", ids_per_file: int = 20_000):
        self.ids_per_file = ids_per_file
        self.spark, self.identifiers, self.required, self.blank_is_null = spark, identifiers, required, blank_is_null
        self.buckets, self.delivery, self.received = buckets, delivery, received

    def _rows(self, df: DataFrame) -> DataFrame:
        ids = {}
        for c in self.identifiers:
            value = canonical_digest(F.col(c))
            ids[f"_{c}"] = F.when(value != "", value) if c in self.blank_is_null else value
        at = F.coalesce(F.unix_micros(F.col(self.received).cast("timestamp")), F.lit((1 << 63) - 1))
        rows = df.where(F.col(self.required).isNotNull() & F.col(self.delivery).isNotNull()).select(F.col(self.delivery).alias("_id"), at.alias("_at"), *(e.alias(k) for k, e in ids.items()))
        flat = [x for k in ids for x in (F.col(k).isNull(), F.col(k))]
        return rows.withColumns({"k1": F.xxhash64(F.lit(1), *flat), "k2": F.xxhash64(F.lit(2), *flat)})

    def stored(self, stages: Stages, rows: DataFrame) -> DataFrame:
        """The written storage (bucket, k1, k2, n, noted), a folder per time bucket."""
        known = F.when(F.col("_at") < (1 << 63) - 1, F.col("_at"))
        low, high, n = rows.agg(F.min(known), F.max(known), F.count("*")).first()
        width = shuffle_width(self.spark)
        buckets = self.buckets or min(64, max(4, -(-n // (width * self.ids_per_file))))
        span = max(1, -(-((high or 0) - (low or 0) + 1) // buckets))
        bucket = F.when(F.col("_at") == (1 << 63) - 1, F.lit(buckets)).otherwise(F.expr(f"(_at - {low or 0}L) div {span}L")).cast("long")
        counted = rows.select(bucket.alias("bucket"), "k1", "k2").mapInArrow(_combine, "bucket long, k1 long, k2 long, n long")
        # the counts of an identifier are added up, and it is screened, where its shard is written: one shuffle
        shards = counted.repartition(width, "k1").sortWithinPartitions("bucket")
        return stages.keep(shards.mapInArrow(_screen, "bucket long, k1 long, k2 long, n long, noted array<long>"), by=["bucket"])

    def verified(self, stages: Stages, storage: DataFrame) -> DataFrame:
        """(k1, k2, n) of the identifiers that were delivered more than once, from the folders of the noted buckets alone."""
        suspects = storage.where(F.size("noted") > 0).select("k1", "k2", F.explode("noted").alias("bucket"))
        suspects = stages.keep(suspects.distinct())
        noted = sorted(r[0] for r in suspects.select("bucket").distinct().collect())  # one number per time bucket at most
        matching = storage.where(F.col("bucket").isin(noted)).select("bucket", "k1", "k2", "n")
        return stages.keep(matching.join(broadcast_if_small(suspects), ["bucket", "k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.sum("n").alias("n")).where("n > 1"))

    def repeats(self, df: DataFrame) -> DataFrame:
        """One row (delivery id) per delivery to drop."""
        stages, key = Stages(self.spark, "deliveries"), ["k1", "k2"]
        rows = self._rows(df)
        verified = self.verified(stages, self.stored(stages, rows))
        several, total = verified.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        is_hot = F.col("n") > max(HOT_LEAST, total // 1000)
        hot, rest = F.broadcast(verified.where(is_hot).select(*key)), verified.where(~is_hot).select(*key)
        # hot messages never meet in one task: their rows stay where they are, and so does the search for their first
        cold = rows.join(broadcast_if_small(rest), key, "left_semi") if several <= BROADCAST_ROWS else rows.join(hot, key, "left_anti").join(rest, key, "left_semi")
        late = self._late(cold, hot=False)
        if not verified.where(is_hot).isEmpty():
            late = late.unionByName(self._late(rows.join(hot, key, "left_semi"), hot=True))
        return late.select(F.col("_id").alias(self.delivery)).distinct()

    def _late(self, repeated: DataFrame, hot: bool) -> DataFrame:
        """Deliveries after the first of their message, the identifiers being compared as they are."""
        names = [f"_{c}" for c in self.identifiers]
        first = repeated.groupBy(*names).agg(F.min(F.struct("_at", "_id")).alias("first"))
        same = [repeated[n].eqNullSafe(first[n]) for n in names]
        return repeated.join(F.broadcast(first) if hot else first, on=same, how="inner").where("struct(_at, _id) > first").select("_id")

    def messages(self, df: DataFrame) -> DataFrame:
        """The rows of df without the deliveries to drop."""
        late = Stages(self.spark, "deliveries-late").keep(self.repeats(df))
        return df.join(broadcast_if_small(late), self.delivery, "left_anti")
