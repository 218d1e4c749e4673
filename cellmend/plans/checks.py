"""Queries that hold ledgers, summaries and splits against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmend.operators import audit, metrics
from cellmend.plans import repair as R
from cellmend.operators.deliveries import canonical_digest
from cellmend.plans.registry import register
from cellmend.sources.tables import table

QUERIES, SQL, query = register()


_OK = "coalesce(parse_status,'') LIKE 'ok%'"


@query(f"SELECT method_name, suite, dataset, count(*) n, count(*) FILTER (coalesce(valid_prediction,false) <> ({_OK})) valid_mismatches, count(*) FILTER (coalesce(correct_repair,false) AND NOT ({_OK})) correct_but_invalid, count(*) FILTER (correct_repair IS NULL) unknown FROM final_records GROUP BY ALL")
def stored_flag_audit(spark, d):
    ok = F.coalesce("parse_status", F.lit("")).startswith("ok")
    n = lambda c: F.sum(c.cast("int"))
    return table(spark, d, "final_records").groupBy("method_name", "suite", "dataset").agg(
        F.count("*").alias("n"), n(F.coalesce("valid_prediction", F.lit(False)) != ok).alias("valid_mismatches"), n(F.coalesce("correct_repair", F.lit(False)) & ~ok).alias("correct_but_invalid"), n(F.col("correct_repair").isNull()).alias("unknown")
    )


@query("SELECT budget, count(*) n FROM (SELECT CASE WHEN abs(budget_share-0.1)<=1e-12 THEN '10pct' WHEN abs(budget_share-0.2)<=1e-12 THEN '20pct' WHEN abs(budget_share-0.3)<=1e-12 THEN '30pct' WHEN budget_share IS NULL THEN 'none' ELSE 'other' END budget FROM final_records_replay) GROUP BY 1")
def budget_selection(spark, d):
    near = lambda x: metrics.near_budget(F.col("budget_share"), x)
    label = F.when(near(0.1), "10pct").when(near(0.2), "20pct").when(near(0.3), "30pct").when(near(None), "none").otherwise("other")
    return table(spark, d, "final_records_replay").groupBy(label.alias("budget")).agg(F.count("*").alias("n"))


@query(R._with(R._SUMMARY, """, b AS (SELECT * FROM summary WHERE method_name='base_repair'), pl AS (SELECT scope, suite, dataset, min(f) lo, max(f) hi FROM b GROUP BY ALL)
SELECT s.method_name, s.backend, s.budget_share, s.scope, s.suite, s.dataset, CASE WHEN e.f IS NOT NULL THEN 'exact' WHEN pl.lo IS NULL THEN 'missing' WHEN pl.lo=pl.hi THEN 'place' ELSE 'ambiguous' END state, round(coalesce(e.f, CASE WHEN pl.lo=pl.hi THEN pl.lo END),9) baseline_f1
FROM summary s LEFT JOIN b e ON s.scope=e.scope AND s.suite=e.suite AND s.dataset=e.dataset AND s.scenario IS NOT DISTINCT FROM e.scenario AND s.backend IS NOT DISTINCT FROM e.backend AND s.budget_share IS NOT DISTINCT FROM e.budget_share AND s.group_size_variant IS NOT DISTINCT FROM e.group_size_variant LEFT JOIN pl ON s.scope=pl.scope AND s.suite=pl.suite AND s.dataset=pl.dataset WHERE s.method_name<>'base_repair'"""))
def matched_baseline(spark, d):
    s = R._summary(spark, d)
    x = metrics.matched_baseline(s.where("method_name <> 'base_repair'"), s.where("method_name = 'base_repair'"), ["scope", "suite", "dataset"], ["scenario", "backend", "budget_share", "group_size_variant"], ["f1"])
    return x.select("method_name", "backend", "budget_share", "scope", "suite", "dataset", "state", F.round("baseline_f1", 9).alias("baseline_f1"))


@query("WITH s AS (SELECT lower(trim(dataset)) dataset, count(DISTINCT cell_id) sampled FROM sample_records GROUP BY 1), p AS (SELECT lower(trim(dataset)) dataset, count(DISTINCT cell_id) population FROM evidence_cells GROUP BY 1) SELECT dataset, coalesce(sampled,0) sampled, coalesce(population,0) population, round(CASE WHEN coalesce(population,0)=0 THEN 0 ELSE coalesce(sampled,0)/population END,9) ratio FROM s FULL JOIN p USING (dataset)")
def population_coverage(spark, d):
    n = lambda t, c: table(spark, d, t).groupBy(F.lower(F.trim("dataset")).alias("dataset")).agg(F.countDistinct("cell_id").alias(c))
    x = n("sample_records", "sampled").join(n("evidence_cells", "population"), "dataset", "full_outer").fillna(0, ["sampled", "population"])
    return x.withColumn("ratio", F.round(F.when(F.col("population") == 0, 0.0).otherwise(F.col("sampled") / F.col("population")), 9))


@query("""WITH a AS (SELECT dataset, count(*) n, count(*) FILTER (p LIKE 'ok%') v FROM (SELECT dataset, cell_id, method_name, backend, arg_max({'x': coalesce(parse_status,'')}, row_index).x p FROM final_records GROUP BY ALL) GROUP BY 1), b AS (SELECT dataset, count(*) n, count(*) FILTER (p LIKE 'ok%') v FROM (SELECT dataset, cell_id, method_name, backend, arg_max({'x': coalesce(parse_status,'')}, row_index).x p FROM final_records_replay GROUP BY ALL) GROUP BY 1)
SELECT dataset, a.n first_cells, b.n second_cells, a.v first_valid, b.v second_valid, coalesce(a.n=b.n AND a.v=b.v, false) equal FROM a FULL JOIN b USING (dataset)""")
def summary_reconciliation(spark, d):
    def side(t, s):
        per = table(spark, d, t).groupBy("dataset", "cell_id", "method_name", "backend").agg(F.max_by(F.coalesce("parse_status", F.lit("")), "row_index").alias("p"))
        return per.groupBy("dataset").agg(F.count("*").alias(f"{s}_cells"), F.sum(F.col("p").startswith("ok").cast("int")).alias(f"{s}_valid"))

    x = side("final_records", "first").join(side("final_records_replay", "second"), "dataset", "full_outer")
    same = (F.col("first_cells") == F.col("second_cells")) & (F.col("first_valid") == F.col("second_valid"))
    return x.select("dataset", "first_cells", "second_cells", "first_valid", "second_valid", F.coalesce(same, F.lit(False)).alias("equal"))


@query("SELECT h.head_id, count(DISTINCT e.dataset) leaked FROM fitted_heads h JOIN (SELECT DISTINCT dataset, base_family FROM evidence_cells WHERE base_family IS NOT NULL) e ON e.dataset = h.target_dataset AND e.base_family <> h.family_left_out GROUP BY 1")
def holdout_overlap(spark, d):
    """Heads whose own target is also stated under another family, so that leaving out one family doesn't leave it out."""
    e = table(spark, d, "evidence_cells").where("base_family is not null").select(F.col("dataset").alias("target_dataset"), "base_family").distinct()
    x = table(spark, d, "fitted_heads").join(e, "target_dataset").where("base_family <> family_left_out")
    return x.groupBy("head_id").agg(F.countDistinct("target_dataset").alias("leaked"))


@query("SELECT suite, count(*) top_pairs, round(avg(coalesce(llm_correct,0)-coalesce(baran_correct,0)),9) top_uplift FROM (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY coalesce(llm_observed_total_tokens,0) DESC, cell_id, coalesce(llm_correct,0), coalesce(baran_correct,0)) k, count(*) OVER (PARTITION BY suite) n FROM evidence_cells) WHERE k <= greatest(1, ceil(0.1*n)) GROUP BY 1")
def top_tenth_uplift(spark, d):
    zero = lambda c: F.coalesce(c, F.lit(0))
    e = table(spark, d, "evidence_cells").select("suite", "cell_id", (-zero("llm_observed_total_tokens")).alias("t"), zero("llm_correct").alias("l"), zero("baran_correct").alias("b"))
    top = metrics.top_share(spark, e, ["suite"], ["t", "cell_id", "l", "b"], 0.1)
    return top.groupBy("suite").agg(F.count("*").alias("top_pairs"), F.round(F.avg(F.col("l") - F.col("b")), 9).alias("top_uplift"))


@query("SELECT model_requested, status, count(*) calls, count(DISTINCT @query_id) queries, round(avg(latency_seconds),6) mean_latency FROM group_checkpoint GROUP BY ALL")
def model_identity_audit(spark, d):
    return table(spark, d, "group_checkpoint").groupBy("model_requested", "status").agg(F.count("*").alias("calls"), F.countDistinct(canonical_digest(F.col("query_id"))).alias("queries"), F.round(F.avg("latency_seconds"), 6).alias("mean_latency"))


@query("SELECT @query_id q, count(DISTINCT suite||':'||dataset) n_owner FROM group_checkpoint WHERE query_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT suite||':'||dataset) > 1")
def owner_purity(spark, d):
    t = table(spark, d, "group_checkpoint").where("query_id is not null").select(canonical_digest(F.col("query_id")).alias("q"), F.concat("suite", F.lit(":"), "dataset").alias("owner"))
    return audit.more_than_one(t, ["q"], ["owner"])


@query("SELECT q, missing, extra FROM (SELECT @query_id q, max(len(cell_ids)) - min(len(cell_ids)) missing, count(DISTINCT array_to_string(list_sort(cell_ids), ',')) - 1 extra FROM group_checkpoint WHERE query_id IS NOT NULL AND cell_ids IS NOT NULL GROUP BY 1) WHERE extra > 0")
def membership_drift(spark, d):
    """Queries whose deliveries name different sets of cells."""
    t = table(spark, d, "group_checkpoint").where("query_id is not null and cell_ids is not null")
    x = t.groupBy(canonical_digest(F.col("query_id")).alias("q")).agg((F.max(F.size("cell_ids")) - F.min(F.size("cell_ids"))).cast("long").alias("missing"), (F.countDistinct(F.array_join(F.array_sort("cell_ids"), ",")) - 1).alias("extra"))
    return x.where("extra > 0")


@query("SELECT error_type, column_name, count(*) n, count(*) FILTER (coalesce(missing_value,'0') NOT IN ('','0')) missing, count(*) FILTER (tuple_pairs IS NOT NULL AND regexp_matches(tuple_pairs, '[0-9]')) with_pairs FROM error_log GROUP BY ALL")
def error_type_counts(spark, d):
    n = lambda c: F.sum(c.cast("int"))
    return table(spark, d, "error_log").groupBy("error_type", "column_name").agg(F.count("*").alias("n"), n(~F.coalesce("missing_value", F.lit("0")).isin("", "0")).alias("missing"), n(F.coalesce(F.col("tuple_pairs").rlike("[0-9]"), F.lit(False))).alias("with_pairs"))


@query("SELECT suite, dataset, CAST(sum(n) AS BIGINT) pairs, count(*) components FROM (SELECT DISTINCT component_id, suite, dataset, violation_pair_count n FROM fd_components) GROUP BY ALL")
def component_pairs(spark, d):
    t = table(spark, d, "fd_components").select("component_id", "suite", "dataset", F.col("violation_pair_count").alias("n")).distinct()
    return t.groupBy("suite", "dataset").agg(F.sum("n").alias("pairs"), F.count("*").alias("components"))
