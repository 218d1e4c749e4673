"""Candidates for a wrong cell: what its column holds, and what stands beside the values of its row.

Sources: `domain`, how frequent a value is among the sound cells of the column; `vicinity_j`, how frequent
it is in rows whose column j has the value it has here. Only sound cells of the row and of other rows
count. Cells whose column and neighbouring values are the same have the same candidates, which are
therefore made once for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmend.session import Stages, broadcast_if_small

KEPT = 10


def _scored(spark: SparkSession, sound: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells (cell_id, sig), scores (sig, candidate, total, sources, groups), signatures (sig, active, active_groups, candidates)).

    sound, errors: dataset, row_idx, col_idx, with dirty_value and cell_id. A value that stands beside none of a
    cell's neighbours can be among the KEPT best only if it is among the KEPT most frequent of its column,
    so others aren't scored; they are counted.
    """
    stages = Stages(spark, "candidates")
    place = ["dataset", "col_idx"]
    values = sound.select("dataset", "row_idx", "col_idx", F.col("dirty_value").alias("candidate"))
    domain = values.groupBy(*place, "candidate").agg(F.count("*").alias("n"))
    total = domain.groupBy(*place).agg(F.sum("n").alias("_all"), F.count("*").alias("candidates"))
    domain = stages.keep(domain.join(total, place).select(*place, "candidate", (F.col("n") / F.col("_all")).alias("dom"), "candidates"))
    frequent = domain.withColumn("_k", F.row_number().over(Window.partitionBy(*place).orderBy(F.desc(F.round("dom", 12)), "candidate"))).where(F.col("_k") <= KEPT)

    beside = values.select("dataset", "row_idx", F.col("col_idx").alias("j"), F.col("candidate").alias("beside"))
    pairs = values.join(beside, ["dataset", "row_idx"]).where("j <> col_idx")
    met = pairs.groupBy(*place, "j", "beside", "candidate").agg(F.count("*").alias("n"))
    near_all = met.groupBy(*place, "j", "beside").agg(F.sum("n").alias("_all"))
    near = stages.keep(met.join(near_all, [*place, "j", "beside"]).select(*place, "j", "beside", "candidate", (F.col("n") / F.col("_all")).alias("vic")))

    # a row has no more neighbours than columns
    neighbours = errors.select("cell_id", "dataset", "row_idx", "col_idx").join(beside, ["dataset", "row_idx"], "left").where("j is null or j <> col_idx")
    signed = neighbours.groupBy("cell_id", *place).agg(F.array_sort(F.collect_list(F.when(F.col("j").isNotNull(), F.struct("j", "beside")))).alias("around"))
    alone = errors.select("cell_id", *place).join(signed, ["cell_id", *place], "left").withColumn("around", F.coalesce("around", F.array().cast("array<struct<j:int,beside:string>>")))
    cells = stages.keep(alone.withColumn("sig", F.sha2(F.to_json(F.struct(*place, "around")), 256)))
    sigs = stages.keep(cells.groupBy("sig").agg(F.first("dataset").alias("dataset"), F.first("col_idx").alias("col_idx"), F.first("around").alias("around")))

    contexts = sigs.select("sig", *place, F.explode("around").alias("_a")).select("sig", *place, "_a.*")
    found = contexts.join(near, [*place, "j", "beside"]).select("sig", *place, "candidate", F.col("vic").alias("score"), F.concat(F.lit("vicinity_"), F.col("j").cast("string")).alias("source"))
    wanted = found.select("sig", *place, "candidate").unionByName(sigs.join(broadcast_if_small(stages.keep(frequent.select(*place, "candidate"))), place).select("sig", *place, "candidate")).distinct()
    own = wanted.join(domain, [*place, "candidate"]).select("sig", *place, "candidate", F.col("dom").alias("score"), F.lit("domain").alias("source"))
    scores = stages.keep(found.unionByName(own))
    active = scores.groupBy("sig").agg(F.countDistinct("source").alias("active"), F.countDistinct(F.split("source", "_")[0]).alias("active_groups"))
    counted = sigs.join(domain.select(*place, "candidates").distinct(), place, "left").join(active, "sig", "left").select("sig", F.coalesce("candidates", F.lit(0)).alias("candidates"), "active", "active_groups")
    each = scores.groupBy("sig", "candidate").agg(F.sum("score").alias("total"), F.count("*").alias("source_count"), F.countDistinct(F.split("source", "_")[0]).alias("groups"))
    support = each.join(counted, "sig").withColumn("support", F.round(F.col("total") / F.col("active"), 9)).drop("total")
    return cells.select("cell_id", "sig"), support, counted


def ranked_candidates(spark: SparkSession, sound: DataFrame, errors: DataFrame) -> DataFrame:
    """(cell_id, candidate, support, source_count, rank): the KEPT best of every cell. A column without sound cells gives none."""
    cells, support, _ = _scored(spark, sound, errors)
    best = support.withColumn("rank", F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("support"), "candidate"))).where(F.col("rank") <= KEPT)
    return cells.join(best, "sig").select("cell_id", "candidate", "support", "source_count", "rank")


def candidate_diagnostics(spark: SparkSession, sound: DataFrame, errors: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per cell: candidates, top and second support and their margin, and of the predicted value (or the best one, where the prediction isn't scored) support, agreement and votes.

    predictions: cell_id, prediction.
    """
    cells, support, counted = _scored(spark, sound, errors)
    order = F.struct((-F.col("support")).alias("s"), "candidate", "source_count", "groups")
    two = support.withColumn("_k", F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("support"), "candidate"))).where("_k <= 2")
    top = two.groupBy("sig").agg(F.array_sort(F.collect_list(order)).alias("top"))
    x = cells.join(counted, "sig").join(top, "sig", "left").join(predictions.select("cell_id", F.col("prediction").alias("candidate")), "cell_id", "left")
    x = x.join(support.select("sig", "candidate", F.struct((-F.col("support")).alias("s"), "candidate", "source_count", "groups").alias("own")), ["sig", "candidate"], "left")
    first, second, chosen = F.col("top")[0], F.try_element_at("top", F.lit(2)), F.coalesce("own", F.col("top")[0])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return x.select(
        "cell_id", F.col("candidates").alias("candidate_count"), zero(-first["s"]).alias("top_support"), zero(-second["s"]).alias("second_support"), F.round(zero(-first["s"]) - zero(-second["s"]), 8).alias("support_margin"),
        zero(-chosen["s"]).alias("predicted_support"), F.round(zero(chosen["source_count"] / F.col("active")), 8).alias("source_agreement"), F.round(zero(chosen["groups"] / F.col("active_groups")), 8).alias("source_group_agreement"),
        F.coalesce(chosen["source_count"], F.lit(0)).alias("source_vote_count"), F.coalesce("active", F.lit(0)).alias("source_model_count"), F.coalesce(chosen["candidate"] == first["candidate"], F.lit(False)).alias("predicted_is_top"),
    )
