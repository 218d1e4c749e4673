"""Repair-shaped inputs laid over the test tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.functions.scalars import cell_id
from cellmend.operators.cells import cell_pairs, errors
from cellmend.operators.profiles import dominant
from cellmend.operators.rules import conflicts
from cellmend.operators.verify import fallback_value
from cellmend.sources.tables import table

PART, CUSTOMER = ["brand", "ptype", "psize"], ["name", "segment", "nation"]


def clean_part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("row_idx"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"), F.col("p_size").cast("string").alias("psize"))


def dirty_part(spark: SparkSession, d: str) -> DataFrame:
    c, r = clean_part(spark, d), F.col("row_idx")
    return c.select("row_idx", F.when(r % 11 == 0, F.lower("brand")).otherwise(F.col("brand")).alias("brand"), F.when(r % 13 == 0, "").otherwise(F.col("ptype")).alias("ptype"), F.when(r % 17 == 0, F.concat(F.lit("0"), "psize")).otherwise(F.col("psize")).alias("psize"))


def clean_customer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("row_idx"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))


def dirty_customer(spark: SparkSession, d: str) -> DataFrame:
    c, r = clean_customer(spark, d), F.col("row_idx")
    return c.select("row_idx", F.when(r % 19 == 0, "").otherwise(F.col("name")).alias("name"), F.when(r % 7 == 0, F.lower("segment")).otherwise(F.col("segment")).alias("segment"), F.when(r % 23 == 0, F.concat(F.lit("0"), "nation")).otherwise(F.col("nation")).alias("nation"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    part = cell_pairs(dirty_part(spark, d), clean_part(spark, d), "row_idx", PART, "source", "part")
    return part.unionByName(cell_pairs(dirty_customer(spark, d), clean_customer(spark, d), "row_idx", CUSTOMER, "source", "customer"))


def found(spark: SparkSession, d: str) -> DataFrame:
    return errors(pairs(spark, d))


def sound(spark: SparkSession, d: str) -> DataFrame:
    """Cells outside the known errors."""
    return pairs(spark, d).where("dirty_value = clean_value")


def base_values(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent sound value of each column, of equals the smallest."""
    n = sound(spark, d).groupBy("dataset", "col_idx", "dirty_value").agg(F.count("*").alias("n"))
    return n.groupBy("dataset", "col_idx").agg(F.min_by("dirty_value", F.struct(-F.col("n"), "dirty_value")).alias("base_value"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Two answers per error cell by whole-number formulas: right, wrong, abstaining, without an item, or failed."""
    r, c, s = F.col("row_idx"), F.col("col_idx"), F.col("s")
    x = found(spark, d).withColumn("s", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("h", (r * 31 + c * 17 + s * 7) % 10)
    h = F.col("h")
    return x.withColumns({
        "status": F.when(h == 9, "failed").otherwise("success"),
        "parse_status": F.when(h == 9, "failed").otherwise("ok"),
        "decision": F.when(h == 7, "abstain").when(h >= 8, None).otherwise("propose"),
        "candidate": F.when(h < 5, F.col("clean_value")).when(h < 7, F.concat(F.lit("~"), "dirty_value")),
        "confidence": 0.5 + h / 20,
        "uplift": ((r * 13 + c * 5 + s) % 100) / 200.0,
        "query_id": F.when(s == 1, F.concat(F.lit("s:"), "cell_id")).otherwise(F.concat_ws(":", F.lit("g"), "dataset", c.cast("string"), F.expr("row_idx div 40").cast("string"))),
        "query_cost": F.when(s == 1, 202).otherwise(468).cast("long"),
        "query_size": s,
    })


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Responses with all that verification looks at."""
    good = sound(spark, d)
    counts = good.groupBy("dataset", "column_name", F.col("dirty_value").alias("value")).agg(F.count("*").alias("n"))
    profile = dominant(good, ["dataset", "column_name"], "dirty_value", "row_idx").select("dataset", "column_name", "dominant_type", "dominant_format")
    x = responses(spark, d).join(base_values(spark, d), ["dataset", "col_idx"])
    x = x.withColumn("fallback", fallback_value(F.when(F.col("row_idx") % 29 == 0, "failed").otherwise("ok"), F.col("base_value"), F.col("dirty_value")))
    x = x.join(profile, ["dataset", "column_name"])
    for name, of in (("candidate_support", "candidate"), ("fallback_support", "fallback")):
        x = x.join(counts.select("dataset", "column_name", F.col("value").alias(of), F.col("n").alias(name)), ["dataset", "column_name", of], "left")
    asked = x.where("dataset = 'part' and candidate is not null").select("cell_id", "s", "row_idx", "column_name", "candidate")
    before_after = conflicts(dirty_part(spark, d), asked, "row_idx", ["brand"], "ptype").where(F.col("column_name").isin("brand", "ptype")).select("cell_id", "s", "fd_before", "fd_after")
    return x.join(before_after, ["cell_id", "s"], "left").fillna(0, ["fd_before", "fd_after"])


# ---- the same in SQL

BASE = """
clean_part AS (SELECT CAST(p_partkey AS INT) row_idx, p_brand brand, p_type ptype, CAST(p_size AS VARCHAR) psize FROM part),
dirty_part AS (SELECT row_idx, CASE WHEN row_idx%11=0 THEN lower(brand) ELSE brand END brand, CASE WHEN row_idx%13=0 THEN '' ELSE ptype END ptype, CASE WHEN row_idx%17=0 THEN '0'||psize ELSE psize END psize FROM clean_part),
clean_customer AS (SELECT CAST(c_custkey AS INT) row_idx, c_name AS name, c_mktsegment segment, CAST(c_nationkey AS VARCHAR) nation FROM customer),
dirty_customer AS (SELECT row_idx, CASE WHEN row_idx%19=0 THEN '' ELSE name END AS name, CASE WHEN row_idx%7=0 THEN lower(segment) ELSE segment END segment, CASE WHEN row_idx%23=0 THEN '0'||nation ELSE nation END nation FROM clean_customer),
pairs AS (SELECT *, suite||':'||dataset||':'||row_idx||':'||col_idx cell_id FROM (
""" + " UNION ALL ".join(f"SELECT 'source' suite, '{t}' dataset, c.row_idx, {i} col_idx, '{n}' column_name, d.{n} dirty_value, c.{n} clean_value FROM dirty_{t} d JOIN clean_{t} c USING (row_idx)" for t, names in (("part", PART), ("customer", CUSTOMER)) for i, n in enumerate(names)) + """)),
found AS (SELECT * FROM pairs WHERE dirty_value <> clean_value),
sound AS (SELECT * FROM pairs WHERE dirty_value = clean_value),
base_values AS (SELECT dataset, col_idx, dirty_value base_value FROM (SELECT *, row_number() OVER (PARTITION BY dataset, col_idx ORDER BY n DESC, dirty_value) k FROM (SELECT dataset, col_idx, dirty_value, count(*) n FROM sound GROUP BY ALL)) WHERE k = 1),
responses AS (SELECT *, CASE WHEN h=9 THEN 'failed' ELSE 'success' END status, CASE WHEN h=9 THEN 'failed' ELSE 'ok' END parse_status, CASE WHEN h=7 THEN 'abstain' WHEN h<7 THEN 'propose' END decision,
  CASE WHEN h<5 THEN clean_value WHEN h<7 THEN '~'||dirty_value END candidate, 0.5+h/20.0::DOUBLE confidence, ((row_idx*13+col_idx*5+s)%100)/200.0::DOUBLE uplift,
  CASE WHEN s=1 THEN 's:'||cell_id ELSE 'g:'||dataset||':'||col_idx||':'||(row_idx//40) END query_id, CASE WHEN s=1 THEN 202 ELSE 468 END query_cost, s query_size
  FROM (SELECT found.*, s, (row_idx*31+col_idx*17+s*7)%10 h FROM found, (VALUES (1),(2)) v(s)))
"""


def value_type_sql(v: str) -> str:
    d = r"\p{Nd}"
    return (
        f"CASE WHEN {v} = '' THEN 'empty' WHEN regexp_matches({v}, '^[+-]?({d}+(\\.{d}*)?|\\.{d}+)$') THEN 'number' "
        f"WHEN regexp_matches({v}, '^({d}{{4}}[-/]{d}{{1,2}}[-/]{d}{{1,2}}|{d}{{1,2}}[-/]{d}{{1,2}}[-/]{d}{{2,4}})$') THEN 'date' "
        f"WHEN regexp_matches({v}, '(?i)^{d}{{1,2}}:{d}{{2}}(:{d}{{2}})?([\\s\\p{{Z}}]*[ap]\\.?m\\.?)?$') THEN 'time' "
        f"WHEN regexp_matches({v}, '^[^\\s\\p{{Z}}@]+@[^\\s\\p{{Z}}@]+\\.[^\\s\\p{{Z}}@]+$') THEN 'email' WHEN regexp_matches({v}, '(?i)^(https?://|www\\.)') THEN 'url' "
        f"WHEN lower({v}) IN ('true','false','yes','no','y','n') THEN 'boolean' ELSE 'text' END"
    )


def mapped_sql(v: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(left({v}, 80), '\\p{{L}}', 'A', 'g'), '[\\p{{Nd}}²³¹]', '9', 'g'), '[\\s\\p{{Z}}\\x1c-\\x1f\\x{{85}}]', '_', 'g')"


def collapsed_sql(m: str, v: str) -> str:
    """m must be a column."""
    return f"CASE WHEN {v} = '' THEN 'EMPTY' ELSE left(array_to_string(list_transform(list_filter(range(1, CAST(length({m}) AS BIGINT) + 1), lambda i: i = 1 OR {m}[i] <> {m}[i - 1]), lambda i: {m}[i]), ''), 40) END"


CANDIDATES = BASE + f"""
, counts AS (SELECT dataset, column_name, dirty_value v, count(*) n FROM sound GROUP BY ALL),
shaped AS (SELECT dataset, column_name, row_idx, {value_type_sql('dirty_value')} t, {collapsed_sql('m', 'dirty_value')} f FROM (SELECT *, {mapped_sql('dirty_value')} m FROM sound WHERE dirty_value <> '')),
profile AS (SELECT dataset, column_name, arg_max(t, (c, -r)) dominant_type FROM (SELECT dataset, column_name, t, count(*) c, min(row_idx) r FROM shaped GROUP BY ALL) GROUP BY ALL),
profile_f AS (SELECT dataset, column_name, arg_max(f, (c, -r)) dominant_format FROM (SELECT dataset, column_name, f, count(*) c, min(row_idx) r FROM shaped GROUP BY ALL) GROUP BY ALL),
valid AS (SELECT * FROM dirty_part WHERE brand <> '' AND ptype <> ''),
by_key AS (SELECT brand, count(*) k FROM valid GROUP BY brand), by_both AS (SELECT brand, ptype, count(*) kd FROM valid GROUP BY brand, ptype),
asked AS (SELECT r.cell_id, r.s, p.brand, p.ptype, p.brand <> '' AND p.ptype <> '' own, CASE WHEN column_name='brand' THEN candidate ELSE p.brand END nb, CASE WHEN column_name='ptype' THEN candidate ELSE p.ptype END nt
  FROM responses r JOIN dirty_part p USING (row_idx) WHERE dataset='part' AND candidate IS NOT NULL AND column_name IN ('brand','ptype')),
fd AS (SELECT a.cell_id, a.s, CASE WHEN own THEN coalesce(k1.k,0)-coalesce(b1.kd,0) ELSE 0 END fd_before,
  CASE WHEN nb <> '' AND nt <> '' THEN (coalesce(k2.k,0) - CAST(own AND a.brand=nb AS INT)) - (coalesce(b2.kd,0) - CAST(own AND a.brand=nb AND a.ptype=nt AS INT)) ELSE 0 END fd_after
  FROM asked a LEFT JOIN by_key k1 ON k1.brand=a.brand LEFT JOIN by_both b1 ON b1.brand=a.brand AND b1.ptype=a.ptype LEFT JOIN by_key k2 ON k2.brand=nb LEFT JOIN by_both b2 ON b2.brand=nb AND b2.ptype=nt),
candidates AS (SELECT r.*, f.fallback, dominant_type, dominant_format, coalesce(cs.n,0) candidate_support, coalesce(fs.n,0) fallback_support, coalesce(fd_before,0) fd_before, coalesce(fd_after,0) fd_after,
    {mapped_sql('candidate')} cm, {mapped_sql('fallback')} fm
  FROM responses r JOIN (SELECT DISTINCT cell_id, CASE WHEN row_idx%29=0 THEN dirty_value ELSE base_value END fallback FROM found JOIN base_values USING (dataset, col_idx)) f USING (cell_id)
  JOIN profile USING (dataset, column_name) JOIN profile_f USING (dataset, column_name)
  LEFT JOIN counts cs ON cs.dataset=r.dataset AND cs.column_name=r.column_name AND cs.v=r.candidate
  LEFT JOIN counts fs ON fs.dataset=r.dataset AND fs.column_name=r.column_name AND fs.v=f.fallback LEFT JOIN fd ON fd.cell_id=r.cell_id AND fd.s=r.s),
flagged AS (SELECT *, {value_type_sql('candidate')} = dominant_type OR dominant_type IN ('text','empty') type_ok, {value_type_sql('fallback')} = dominant_type OR dominant_type IN ('text','empty') base_type_ok,
  {collapsed_sql('cm', 'candidate')} = dominant_format OR dominant_type='text' format_ok, {collapsed_sql('fm', 'fallback')} = dominant_format OR dominant_type='text' base_format_ok FROM candidates),
scored AS (SELECT *, 0.40::DOUBLE*least(1,greatest(0,confidence)) + 0.25::DOUBLE*least(1,greatest(0,uplift/0.5::DOUBLE)) + 0.10::DOUBLE*CAST(type_ok AS INT) + 0.05::DOUBLE*CAST(format_ok AS INT) + 0.10::DOUBLE*CAST(candidate_support>fallback_support AS INT) + 0.10::DOUBLE*CAST(fd_after<fd_before AS INT) sc,
  candidate_support>fallback_support OR fd_after<fd_before OR (type_ok AND NOT base_type_ok) OR (format_ok AND NOT base_format_ok) signal FROM flagged),
decided AS (SELECT *, CASE WHEN parse_status NOT IN ('ok','partial','ok_item') THEN 'invalid_llm_output' WHEN decision IS NULL OR decision <> 'propose' THEN 'fallback_decision' WHEN candidate IS NULL THEN 'missing_repair' WHEN candidate='' THEN 'empty_repair'
  WHEN candidate=dirty_value THEN 'unchanged_dirty_value' WHEN candidate=fallback THEN 'equivalent_to_base' WHEN uplift<=0 THEN 'non_positive_predicted_gain' WHEN confidence<0.55 THEN 'low_llm_confidence' WHEN fd_after>fd_before THEN 'public_fd_worse'
  WHEN NOT type_ok AND base_type_ok AND NOT fd_after<fd_before THEN 'type_worse_than_base' WHEN NOT format_ok AND base_format_ok AND NOT fd_after<fd_before THEN 'format_worse_than_base' WHEN NOT signal THEN 'no_comparative_signal' WHEN sc<0.55::DOUBLE THEN 'verification_score_below_threshold' ELSE 'accepted' END reason FROM scored)
"""
