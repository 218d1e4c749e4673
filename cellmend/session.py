"""Session helpers: building a session and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "cellmend", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC as its zone and AQE on; any setting given in conf wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from spark.checkpoint.dir of the session. Only where that is unset and all runs in this
    process (tests, a single machine) a temporary folder is made and kept for the life of the context; a
    cluster without the setting is refused.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellmend-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_made: set[str] = set()


def clear_stages(spark: SparkSession) -> None:
    """Deletes all tables that operators of this process have written; results that still read them can't be read after it."""
    for base in sorted(_made):
        _delete(spark, base)
    _made.clear()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Stages:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of an executor, gives the planner real sizes, and lets a later
    round prune columns. `drop` deletes a table once nothing reads it any more, `clear_stages` all of them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/cellmend-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, str]:
        """by: columns whose values get a folder each."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        _made.add(self.base)
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*(by or [])).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        return self.write(df, by)[0]

    def drop(self, path: str) -> None:
        _delete(self.spark, path)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: rows of a few numbers that may be broadcast, about 16 MB; more are joined by a shuffle
BROADCAST_ROWS = 300_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (a written table of narrow rows), marked for broadcast if it has no more rows than `limit`."""
    return F.broadcast(df) if df.count() <= limit else df
