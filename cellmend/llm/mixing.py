"""A mix of sources with target shares, by hash thresholds.

Every document has a place on a line of 64 bits, the hash of its id. A source gives the documents below
its threshold one copy more than the others. The threshold is found from sums of tokens by source and
hash bucket: the bucket in which the wanted number of tokens is reached is cut into finer buckets, again
and again, until it holds one document (or documents of one hash). All documents are read for the first sums
and once more for those of the boundary buckets, which the finer levels read alone; what is shuffled of a
level are sums, a row per source and bucket. A larger budget keeps every document of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmend.llm.bpe import DEFAULT_DIRECTORY, encode_column
from cellmend.session import Stages

LEVEL_BITS = [12, 12, 12, 12, 12, 4]


def _target_rows(targets: DataFrame) -> DataFrame:
    """One row per source with a positive share; a source stated twice has the sum of its shares and the smaller cap."""
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    return t.withColumn("target_share", F.greatest(F.lit(0.0), F.coalesce("target_share", F.lit(0.0)))).withColumn("cap", F.greatest(F.lit(0), "cap"))


class SourceMix:
    """Chooses how often each document is used.

    budget: tokens of the whole mix; by default as many as the documents of all targeted sources have
    together. A source that can't reach its part with every document used max_repeats times is used up;
    the shares reported are those of the mix as it is. Shares add up to one, so where one source falls short
    the others lie above their targets; `exact_budget` is the largest one at which none falls short (of the
    sources that have tokens). Null sources and sources without a target are not
    used. Documents without tokens, and repeated rows of one doc_id, follow the same rule (the same
    copies for the same doc_id).
    """

    def __init__(self, spark: SparkSession, tokenizer: str = "byte_bpe_50k", directory: str = DEFAULT_DIRECTORY, budget: int | None = None):
        self.spark, self.tokenizer, self.directory, self.budget = spark, tokenizer, directory, budget

    def _counted(self, stages: Stages, documents: DataFrame) -> DataFrame:
        own = documents.select("doc_id", "source", "text")
        counted = encode_column(self.spark, own, "text", ["doc_id", "source"], "n_tokens", count_only=True, tokenizer=self.tokenizer, directory=self.directory)
        return stages.keep(counted.withColumn("h", F.xxhash64(F.lit(7), "doc_id")))

    def _plan(self, stages: Stages, docs: DataFrame, targets: DataFrame) -> DataFrame:
        """Per source: tokens, full copies `base`, and `theta`: documents with h <= theta get one more."""
        sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
        plan = _target_rows(targets).join(sums, "source", "left").fillna(0, ["tokens", "documents"])
        if self.budget is None:
            plan = plan.withColumn("budget", F.lit(float(plan.agg(F.sum("tokens")).first()[0] or 0)))
        else:
            plan = plan.withColumn("budget", F.lit(float(self.budget)))
        want = F.col("target_share") * F.col("budget")
        base = F.when(F.col("tokens") > 0, F.least(F.col("cap"), F.floor(want / F.col("tokens")))).otherwise(0).cast("int")
        plan = plan.withColumn("base", base).withColumn("rest", F.when((F.col("base") < F.col("cap")) & (F.col("tokens") > 0), want - F.col("base") * F.col("tokens")).otherwise(0.0))
        plan = stages.keep(plan)

        # the bucket of each source in which `rest` is reached, at ever finer levels; below: tokens of the buckets before it
        at = plan.where("rest > 0").select("source", "rest", F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("prefix"))
        used, inside = 0, docs.select("source", "h", "n_tokens")
        unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))  # in unsigned order, so that prefixes are in the order of h
        top = lambda bits: F.shiftrightunsigned(unsigned, 64 - bits) if bits < 64 else unsigned
        for bits in LEVEL_BITS:
            held = inside.join(at.select("source", "rest", "below", "prefix"), "source")
            if used:
                held = held.where(top(used) == F.col("prefix"))
            sums = held.groupBy("source", "rest", "below", top(used + bits).alias("p")).agg(F.sum("n_tokens").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
            running = F.sum("n").over(Window.partitionBy("source").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            reached = sums.withColumn("upto", F.col("below") + running).where("upto >= rest")
            first = F.min_by(F.struct("rest", (F.col("upto") - F.col("n")).alias("below"), F.col("p").alias("prefix"), "n", "low", "high"), F.struct("upto", "low"))
            at = stages.keep(reached.groupBy("source").agg(first.alias("b")).select("source", "b.*"))
            if at.where("low < high").isEmpty():
                break
            if not used:
                inside = stages.keep(inside.join(at.select("source", "prefix"), "source").where(top(bits) == F.col("prefix")).select("source", "h", "n_tokens"))
            used += bits
        # of the last bucket all go or none, whichever is nearer
        theta = at.select("source", F.when(F.col("below") + F.col("n") / 2 <= F.col("rest"), F.col("high")).otherwise(F.when(F.col("low") > -(1 << 63), F.col("low") - 1)).alias("theta"))
        return stages.keep(plan.join(theta, "source", "left"))

    def mix(self, documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents with copies > 0, report by source)."""
        stages = Stages(self.spark, "mix")
        docs = self._counted(stages, documents)
        plan = self._plan(stages, docs, targets)
        copies = F.col("base") + F.coalesce((F.col("h") <= F.col("theta")).cast("int"), F.lit(0))
        chosen = docs.join(plan.select("source", "base", "theta"), "source").select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")
        got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("used_documents"), F.max("copies").alias("most_copies"))
        report = stages.keep(plan.join(got, "source", "left").fillna(0, ["mix_tokens", "used_documents", "most_copies"]))
        total = float(report.agg(F.sum("mix_tokens")).first()[0] or 0)
        share = F.col("mix_tokens") / F.lit(total) if total else F.lit(0.0)
        exact = report.agg(F.min(F.when((F.col("target_share") > 0) & (F.col("tokens") > 0), F.floor(F.col("tokens") * F.col("cap") / F.col("target_share"))))).first()[0]
        report = report.select(
            "source", "target_share", share.alias("actual_share"), F.round(F.col("target_share") * F.col("budget")).cast("long").alias("target_tokens"), "mix_tokens", F.col("tokens").alias("source_tokens"),
            F.col("documents").alias("source_documents"), "used_documents", F.col("cap").alias("max_repeats"), "most_copies", (F.col("tokens") * F.col("cap") >= F.col("target_share") * F.col("budget")).alias("target_reachable"), F.lit(exact).cast("long").alias("exact_budget"), F.lit(self.tokenizer).alias("tokenizer"),
        )
        return chosen.join(report.select("source", "target_share", "actual_share", "tokenizer"), "source"), report
