"""Queries that audit answers used again, selections, costs and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.functions import scalars as S
from cellmend.operators import audit, cells, contracts, groups, replay, selection, verify
from cellmend.plans import overlays as O
from cellmend.plans import repair as R
from cellmend.plans import workflow as W
from cellmend.plans.registry import register
from cellmend.sources.tables import table

QUERIES, SQL, query = register()

_Q = "SELECT *, @query_id q, @prompt_hash p, nullif(@provider_request_hash, '') r FROM group_checkpoint WHERE query_id IS NOT NULL"
_EARLY = "hour(received_at) < 12"


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    return R._checkpoint(spark, d).withColumns({"p": F.col("prompt_hash"), "r": F.col("provider_request_hash")})


def _early():
    """Deliveries of a morning, the others being late."""
    return F.coalesce(F.hour("received_at") < 12, F.lit(False))


# ---- answers

@query("SELECT delivery_id, reason FROM (SELECT *, CASE WHEN coalesce(status,'') NOT IN ('success','failed') THEN 'unknown_status' WHEN status='success' AND trim(coalesce(response_text,''))='' THEN 'success_without_text' WHEN status='success' AND coalesce(parse_status,'')='' THEN 'success_without_parse_status' WHEN status='failed' AND coalesce(parse_status,'') IN ('ok','partial') THEN 'failure_with_answer' END reason FROM group_checkpoint) WHERE reason IS NOT NULL")
def inconsistent_deliveries(spark, d):
    return replay.inconsistent_rows(table(spark, d, "group_checkpoint"), ["success"], ["failed"]).select("delivery_id", "reason")


@query(f"WITH c AS ({_Q}), f AS (SELECT q, arg_min({{'p': p, 'r': r, 'm': model_requested, 'c': array_to_string(cell_ids, ',')}}, delivery_id) x FROM c GROUP BY q), l AS (SELECT q, arg_max({{'p': p, 'r': r, 'm': model_requested, 'c': array_to_string(cell_ids, ',')}}, delivery_id) y FROM c GROUP BY q), b AS (SELECT * FROM f JOIN l USING (q)) SELECT q, field, \"before\", \"after\" FROM (SELECT q, unnest(['p','r','model_requested','cells']) field, unnest([x.p, x.r, x.m, x.c]) AS \"before\", unnest([y.p, y.r, y.m, y.c]) AS \"after\" FROM b) WHERE \"before\" IS DISTINCT FROM \"after\"")
def identity_drift(spark, d):
    """Fields in which the last delivery of a query differs from the request, taken as its first delivery states it."""
    x = _deliveries(spark, d).select("q", "p", "r", "model_requested", F.array_join("cell_ids", ",").alias("cells"), "delivery_id")
    pick = lambda f: x.groupBy("q").agg(f(F.struct("p", "r", "model_requested", "cells"), "delivery_id").alias("s")).select("q", "s.*")
    return replay.identity_drift(pick(F.max_by), pick(F.min_by), "q", ["p", "r", "model_requested", "cells"])


@query(f"WITH c AS ({_Q}) SELECT delivery_id FROM c WHERE {_EARLY} IS NOT TRUE AND (q, p, r, model_requested, phase) IN (SELECT (q, p, r, model_requested, phase) FROM c WHERE {_EARLY} AND p IS NOT NULL AND r IS NOT NULL AND model_requested IS NOT NULL AND phase IS NOT NULL)")
def matching_identity(spark, d):
    """Late deliveries that agree with an early one in all five fields of a request."""
    x = _deliveries(spark, d)
    return replay.matching_identity(x.where(~_early()), x.where(_early()), ["q", "p", "r", "model_requested", "phase"]).select("delivery_id")


@query(f"WITH c AS ({_Q}), last AS (SELECT q, p, arg_max({{'r': r, 's': status, 'v': phase}}, delivery_id) z FROM c WHERE {_EARLY} AND model_requested='gen-small' GROUP BY q, p), req AS (SELECT q, p, min(r) r, min(phase) phase FROM c WHERE {_EARLY} IS NOT TRUE GROUP BY q, p) SELECT outcome, count(*) n FROM (SELECT CASE WHEN z.s IS DISTINCT FROM 'success' THEN 'not_successful' WHEN phase IS DISTINCT FROM z.v THEN 'schema_mismatch' WHEN req.r IS DISTINCT FROM z.r THEN 'request_hash_mismatch' ELSE 'imported' END outcome FROM req JOIN last USING (q, p)) GROUP BY 1")
def reuse_import(spark, d):
    """Late requests that early answers of one model may serve, and why others may not; the phase stands for the version of the prompt."""
    x = _deliveries(spark, d).select("q", F.col("p").alias("prompt_hash"), F.col("r").alias("request_hash"), F.col("phase").alias("schema"), F.col("model_requested").alias("model"), "status", "delivery_id", "received_at")
    wanted = x.where(~_early()).groupBy("q", "prompt_hash").agg(F.min("request_hash").alias("request_hash"), F.min("schema").alias("schema"))
    return replay.reusable(wanted, x.where(_early()), F.lit("gen-small"), ["delivery_id"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH c AS ({_Q}), last AS (SELECT q, arg_max({{'s': status}}, delivery_id) z FROM c WHERE {_EARLY} GROUP BY q), req AS (SELECT q, CAST(max(length(coalesce(response_text,''))) AS BIGINT) t FROM c GROUP BY q) SELECT q, CASE WHEN z.s='success' THEN 'cached_success' WHEN z IS NOT NULL THEN 'cached_failure' ELSE 'online' END state, CASE WHEN z.s='success' THEN 0 ELSE t END online_tokens FROM req LEFT JOIN last USING (q)")
def union_plan(spark, d):
    """Every query against the early ledger: answered, failed, or still to be asked, with its planned tokens."""
    x = _deliveries(spark, d)
    req = x.groupBy("q").agg(F.max(F.length(F.coalesce("response_text", F.lit("")))).cast("long").alias("t"))
    return replay.union_plan(req, x.where(_early()).select("q", "status", "delivery_id"), ["q"], ["delivery_id"], "t").select("q", "state", "online_tokens")


@query(f"WITH c AS ({_Q}), last AS (SELECT q, arg_max({{'s': status}}, delivery_id) z FROM c WHERE {_EARLY} GROUP BY q), req AS (SELECT q, CAST(max(length(coalesce(response_text,''))) AS BIGINT) t FROM c GROUP BY q), pl AS (SELECT q, CASE WHEN z.s='success' THEN 'cached_success' WHEN z IS NOT NULL THEN 'cached_failure' ELSE 'online' END state, CASE WHEN z.s='success' THEN 0 ELSE t END o FROM req LEFT JOIN last USING (q)) SELECT count(*) requests, count(*) FILTER (state='cached_success') cached_success, count(*) FILTER (state='cached_failure') cached_failure, count(*) FILTER (state='online') online, CAST(sum(o) AS BIGINT) online_tokens, CAST(1000 + 6*sum(o) AS BIGINT) retry_adjusted_cap FROM pl")
def union_plan_totals(spark, d):
    return replay.plan_totals(union_plan(spark, d), 1000, 6)


@query("SELECT CAST(coalesce(sum(CASE WHEN status='success' THEN length(coalesce(response_text,'')) ELSE 512*greatest(1, coalesce(attempts,0)) END),0) AS BIGINT) debit FROM group_checkpoint WHERE NOT coalesce(cache_hit,false)")
def provider_debit(spark, d):
    """Known usage of successes and an estimate of 512 for every attempt of other deliveries, caches left out."""
    t = table(spark, d, "group_checkpoint").withColumns({"known": F.when(F.col("status") == "success", F.length(F.coalesce("response_text", F.lit("")))), "estimate": F.lit(512), "unknown": F.lit(0)})
    return replay.provider_debit(t, "known", "estimate", "attempts", "unknown", "cache_hit")


@query(f"WITH c AS ({_Q}), x AS (SELECT q, count(*) history, count(DISTINCT coalesce(p,'')) prompt_hashes, count(DISTINCT coalesce(r,'')) request_hashes, arg_max(coalesce(len(cell_ids),0), delivery_id) cells, min(CAST(coalesce(p,'')<>'' AS INT)) ok_p, min(CAST(coalesce(r,'')<>'' AS INT)) ok_r FROM c GROUP BY q) SELECT q, history, prompt_hashes, request_hashes, CAST(cells AS INT) cells, CASE WHEN prompt_hashes<>1 OR ok_p=0 THEN 'prompt_drift' WHEN request_hashes<>1 OR ok_r=0 THEN 'request_drift' WHEN cells<>1 THEN 'not_singleton' END reason FROM x")
def reuse_audit(spark, d):
    x = _deliveries(spark, d).withColumn("cell_ids", F.coalesce("cell_ids", F.array().cast("array<string>")))
    return replay.reuse_audit(x, "q", "p", "r", "cell_ids", ["delivery_id"])


@query(f"""WITH c AS ({_Q}), o AS (SELECT q, arg_max({{'p': p, 'r': r, 's': status, 't': parse_status, 'x': response_text}}, delivery_id) a FROM c WHERE {_EARLY} GROUP BY q), n AS (SELECT q, arg_max({{'p': p, 'r': r, 's': status, 't': parse_status, 'x': response_text, 'k': CASE WHEN cache_hit THEN 'bank' WHEN attempts>1 THEN 'supplemental' ELSE 'first' END}}, delivery_id) b FROM c WHERE {_EARLY} IS NOT TRUE GROUP BY q),
j AS (SELECT q, a.p IS DISTINCT FROM b.p OR a.r IS DISTINCT FROM b.r drift, array_to_string(list_filter([CASE WHEN a.t IS DISTINCT FROM b.t THEN 'parse_status' END, CASE WHEN a.x IS DISTINCT FROM b.x THEN 'response_text' END, CASE WHEN a.s IS DISTINCT FROM b.s THEN 'status' END], lambda f: f IS NOT NULL), ',') changed_fields, b.k k FROM o JOIN n USING (q))
SELECT q, drift, changed_fields, CASE WHEN changed_fields='' THEN NULL WHEN k='bank' THEN 'cache_union' WHEN k='supplemental' THEN 'supplemental' ELSE 'unsupported' END cause FROM j WHERE drift OR changed_fields<>''""")
def execution_differences(spark, d):
    """Queries whose early and late answers differ, with what the change is put down to."""
    x = _deliveries(spark, d).withColumn("role", F.when(F.col("cache_hit"), "bank").when(F.col("attempts") > 1, "supplemental").otherwise("first"))
    last = lambda df: df.groupBy("q").agg(F.max_by(F.struct("p", "r", "status", "parse_status", "response_text", "role"), "delivery_id").alias("s")).select("q", "s.*")
    return replay.execution_differences(last(x.where(_early())), last(x.where(~_early())), "q", ["p", "r"], ["status", "parse_status", "response_text"])


@query(f"WITH c AS ({_Q}), s AS (SELECT DISTINCT q FROM c), l AS (SELECT q, arg_max({{'i': delivery_id, 's': status}}, delivery_id) z FROM c WHERE {_EARLY} GROUP BY q) SELECT q, z.i delivery_id, z.s status, z IS NOT NULL found FROM s LEFT JOIN l USING (q)")
def selected_executions(spark, d):
    x = _deliveries(spark, d).select("q", "delivery_id", "status", "received_at")
    return replay.selected_executions(x, x.where(_early()).drop("received_at"), ["q"], ["delivery_id"]).select("q", "delivery_id", "status", "found")


@query("SELECT count(*) AS rows, count(DISTINCT coalesce(CAST(delivery_id AS VARCHAR), chr(0))) distinct_keys, count(*) FILTER (delivery_id IS NULL) null_keys, count(*) = count(DISTINCT coalesce(CAST(delivery_id AS VARCHAR), chr(0))) AND count(*) FILTER (delivery_id IS NULL) = 0 ok FROM group_checkpoint")
def delivery_contract(spark, d):
    return replay.contract(table(spark, d, "group_checkpoint"), ["delivery_id"])


@query()
def parse_drift(spark, d):
    """Deliveries whose text, parsed again, doesn't give their stored status; tested on hand-made answers."""
    t = table(spark, d, "group_checkpoint").select("delivery_id", "query_id", "response_text", "cell_ids", "parse_status")
    return replay.parse_drift(t).select("delivery_id", "parse_status", "parsed_status")


@query("SELECT cell_id, reason, count(*) n FROM (SELECT cell_id, CASE WHEN b <> (coalesce(baran_prediction,'')=coalesce(clean_value,'')) THEN 'base_verdict' WHEN m AND coalesce(llm_prediction,'')<>coalesce(clean_value,'') THEN 'llm_verdict' WHEN outcome_quadrant IS DISTINCT FROM 'n_'||CAST(b AS INT)||CAST(m AS INT) THEN 'quadrant' END reason FROM (SELECT *, coalesce(baran_correct=1,false) b, coalesce(llm_correct=1,false) m FROM evidence_cells)) WHERE reason IS NOT NULL GROUP BY ALL")
def evidence_drift(spark, d):
    x = replay.evidence_drift(table(spark, d, "evidence_cells"), "baran_prediction", "baran_correct", "llm_prediction", "llm_correct", "outcome_quadrant")
    return x.groupBy("cell_id", "reason").agg(F.count("*").alias("n"))


@query(f"WITH fr AS ({R._FR}) SELECT method_name, suite, dataset, count(*) n, count(*) FILTER (stored AND NOT now_) no_longer, count(*) FILTER (NOT stored AND now_) newly FROM (SELECT *, coalesce(correct_repair,false) stored, coalesce(parse_status,'') LIKE 'ok%' AND trim(regexp_replace(coalesce(prediction,''), '[\t\n ]+', ' ', 'g'), ' ') = trim(regexp_replace(coalesce(clean_value,''), '[\t\n ]+', ' ', 'g'), ' ') now_ FROM (SELECT * REPLACE (replace(prediction,'&amp;','&') AS prediction, replace(clean_value,'&amp;','&') AS clean_value) FROM fr)) GROUP BY ALL")
def recomputed_verdicts(spark, d):
    """Verdicts of the ledger that its own values don't bear out, predictions and clean values being normalised."""
    r = R._records(spark, d)
    now = F.coalesce("parse_status", F.lit("")).startswith("ok") & (S.normalize_value(F.col("prediction")) == S.normalize_value(F.col("clean_value")))
    x = r.withColumns({"stored": F.coalesce("correct_repair", F.lit(False)), "now": now})
    n = lambda c: F.sum(c.cast("int"))
    return x.groupBy("method_name", "suite", "dataset").agg(F.count("*").alias("n"), n(F.col("stored") & ~F.col("now")).alias("no_longer"), n(~F.col("stored") & F.col("now")).alias("newly"))


# ---- identities of splits and ledgers

@query("WITH tr AS (SELECT * FROM evidence_cells WHERE suite='curated'), te AS (SELECT * FROM evidence_cells WHERE suite<>'curated') " + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) shared FROM (SELECT DISTINCT CAST({c} AS VARCHAR) v FROM tr WHERE {c} IS NOT NULL INTERSECT SELECT DISTINCT CAST({c} AS VARCHAR) FROM te WHERE {c} IS NOT NULL)" for c in ("dataset", "base_family", "cell_id", "row_cluster", "column_name")))
def split_overlaps(spark, d):
    """What the two suites share of each of five columns."""
    e = table(spark, d, "evidence_cells")
    return replay.overlaps(e.where("suite = 'curated'"), e.where("suite <> 'curated'"), ["dataset", "base_family", "cell_id", "row_cluster", "column_name"])


@query("WITH a AS (SELECT cell_id, count(*) n FROM sample_records WHERE cell_id IS NOT NULL GROUP BY 1), b AS (SELECT cell_id, count(*) n FROM evidence_cells WHERE cell_id IS NOT NULL GROUP BY 1) SELECT cell_id, CAST(coalesce(a.n,0) AS BIGINT) lefts, CAST(coalesce(b.n,0) AS BIGINT) rights FROM a FULL JOIN b USING (cell_id) WHERE coalesce(a.n,0)<>1 OR coalesce(b.n,0)<>1")
def join_violations(spark, d):
    """Cells that the sample and the evidence don't pair one to one."""
    known = lambda t: table(spark, d, t).where("cell_id is not null")
    return contracts.join_violations(known("sample_records"), known("evidence_cells"), ["cell_id"])


@query("WITH c AS (SELECT cell_id, arg_max({'p': prediction, 'c': clean_value}, row_index) x FROM final_records WHERE method_name='llm_only' GROUP BY 1), e AS (SELECT cell_id, min({'p': llm_prediction, 'c': clean_value}) y FROM evidence_cells GROUP BY 1) SELECT cell_id, field, \"before\", \"after\" FROM (SELECT cell_id, unnest(['prediction','clean_value']) field, unnest([x.p, x.c]) AS \"before\", unnest([y.p, y.c]) AS \"after\" FROM c JOIN e USING (cell_id)) WHERE \"before\" IS DISTINCT FROM \"after\"")
def cross_ledger_identity(spark, d):
    """Cells whose answer alone isn't the same in the ledger and in the evidence, the smallest statement of a cell counting."""
    a = table(spark, d, "final_records").where("method_name = 'llm_only'").groupBy("cell_id").agg(F.max_by(F.struct("prediction", "clean_value"), "row_index").alias("x")).select("cell_id", "x.*")
    b = table(spark, d, "evidence_cells").groupBy("cell_id").agg(F.min(F.struct(F.col("llm_prediction").alias("prediction"), "clean_value")).alias("x")).select("cell_id", "x.*")
    return audit.field_differences(a, b, ["cell_id"], ["prediction", "clean_value"])


@query("SELECT s.* EXCLUDE (dataset_) FROM (SELECT sample_id, cell_id, lower(trim(dataset)) dataset_ FROM sample_records) s WHERE dataset_ IS NOT NULL AND dataset_ <> 'clinic_main'")
def without_datasets(spark, d):
    x = table(spark, d, "sample_records").select("sample_id", "cell_id", F.lower(F.trim("dataset")).alias("dataset")).where("dataset is not null")
    return contracts.without_datasets(x, spark.createDataFrame([("clinic_main",)], "dataset string"), ["dataset"]).select("sample_id", "cell_id")


@query("SELECT row_id, CASE WHEN n BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST(n AS BIGINT) END n FROM (SELECT log_id row_id, TRY_CAST(CASE WHEN regexp_matches(trim(row_id), '^[+-]?[0-9]+([.]0*)?$') THEN split_part(trim(row_id), '.', 1) END AS HUGEINT) n FROM error_log)")
def exact_integers(spark, d):
    return table(spark, d, "error_log").select(F.col("log_id").alias("row_id"), contracts.exact_integer(F.col("row_id")).try_cast("long").alias("n"))


@query("SELECT scenario, backend, group_size_variant, budget_ok, count(*) n FROM (SELECT coalesce(nullif(trim(scenario),''),'main') scenario, coalesce(nullif(trim(backend),''),'none') backend, coalesce(nullif(trim(group_size_variant),''),'all') group_size_variant, budget_share IS NULL OR (isfinite(budget_share) AND budget_share>=0) budget_ok FROM final_records) GROUP BY ALL")
def slice_defaults(spark, d):
    return contracts.slice_defaults(table(spark, d, "final_records").select("scenario", "backend", "group_size_variant", "budget_share")).groupBy("scenario", "backend", "group_size_variant", "budget_ok").agg(F.count("*").alias("n"))


# ---- costs and selections

_COSTED = W._ACTIONS + """, priced AS (SELECT *, CAST(CASE WHEN size=1 THEN 192 + (SELECT max(octet_length(encode(f.dirty_value))) FROM found f WHERE f.cell_id=ids[1]) ELSE 64 + 150*size END AS BIGINT) query_cost FROM actions)"""


def _priced(spark, d):
    """Actions with costs of their own: a cell alone costs by its text, a group by its size."""
    length = O.found(spark, d).select(F.col("cell_id").alias("_c"), F.octet_length("dirty_value").alias("_l"))
    a = W._actions(spark, d)
    x = a.join(length, a.cell_ids[0] == F.col("_c"), "left")
    return x.withColumn("query_cost", F.when(F.col("size") == 1, 192 + F.col("_l")).otherwise(64 + 150 * F.col("size")).cast("long")).drop("_c", "_l")


@query(f"WITH {_COSTED}, m AS (SELECT query_id, unnest(ids) cell_id FROM priced), s AS (SELECT ids[1] cell_id, min(query_cost) c FROM priced WHERE size=1 GROUP BY 1), t AS (SELECT query_id, CAST(sum(c) AS BIGINT) singleton_sum FROM m JOIN s USING (cell_id) GROUP BY 1) SELECT query_id, CAST(size AS INT) size, query_cost, singleton_sum, round(1 - query_cost/singleton_sum, 9) saving_ratio FROM priced JOIN t USING (query_id)")
def group_savings(spark, d):
    return contracts.group_savings(_priced(spark, d)).select("query_id", "size", "query_cost", "singleton_sum", F.round("saving_ratio", 9).alias("saving_ratio"))


@query(f"WITH {_COSTED} SELECT dataset, count(*) cells, CAST(sum(c) AS BIGINT) reference_cost FROM (SELECT dataset, ids[1] cell_id, min(query_cost) c FROM priced WHERE size=1 GROUP BY ALL) GROUP BY dataset")
def singleton_reference(spark, d):
    """What asking every cell of a data set alone would cost."""
    costs = contracts.singleton_costs(_priced(spark, d)).join(O.found(spark, d).select("cell_id", "dataset"), "cell_id")
    return costs.groupBy("dataset").agg(F.count("*").alias("cells"), F.sum("singleton_cost").alias("reference_cost"))


@query(f"WITH {_COSTED}, s AS (SELECT *, 40000 budget FROM priced WHERE substr(query_id,1,1) < '6'), c AS (SELECT dataset, count(DISTINCT x) cells FROM (SELECT dataset, unnest(ids) x FROM s) GROUP BY 1) SELECT dataset, count(*) queries, count(*) FILTER (size>1) AS \"groups\", CAST(sum(query_cost) AS BIGINT) AS cost, max(budget) budget, CAST(sum(size) AS BIGINT) incidences, max(cells) cells, CAST(max(budget)-sum(query_cost) AS BIGINT) slack, sum(query_cost)<=max(budget) AS \"within\", round(1-max(cells)/sum(size),9) AS \"overlap\" FROM s JOIN c USING (dataset) GROUP BY dataset")
def selection_audit_full(spark, d):
    """Tokens, slack, coverage and overlap of a choice of queries by the first digit of their ids."""
    s = _priced(spark, d).where(F.substring("query_id", 1, 1) < "6").withColumn("budget", F.lit(40000))
    return contracts.selection_audit(s, ["dataset"])


_CHOSEN = f"WITH {W._ACTIONS}, old_ AS (SELECT dataset, \"view\", query_id FROM actions WHERE substr(query_id,1,1) < 'a'), new_ AS (SELECT dataset, \"view\", query_id FROM actions WHERE substr(query_id,1,1) >= '4'), u AS (SELECT dataset, \"view\", query_id, max(a) a, max(b) b FROM (SELECT *, 1 a, 0 b FROM old_ UNION ALL SELECT *, 0, 1 FROM new_) GROUP BY ALL), sd AS (SELECT dataset, \"view\", count(*) FILTER (b=1 AND a=0) added, count(*) FILTER (a=1 AND b=0) removed, count(*) FILTER (a=1 AND b=1) kept, round(count(*) FILTER (a=1 AND b=1)/count(*),9) jaccard, count(*) FILTER (a=1 AND b=1)=count(*) equal FROM u GROUP BY ALL)"


def _chosen(spark, d):
    a = W._actions(spark, d)
    digit = F.substring("query_id", 1, 1)
    return contracts.selection_differences(a.where(digit < "a"), a.where(digit >= "4"), ["dataset", "view"])


@query(_CHOSEN + ' SELECT dataset, "view", added, removed, kept, jaccard, equal FROM sd')
def selection_differences(spark, d):
    return _chosen(spark, d)


@query(_CHOSEN + " SELECT CASE WHEN grouping(dataset)=1 THEN 'ALL' ELSE dataset END dataset, count(*) slices, count(*) FILTER (NOT equal) changed, round(avg(jaccard),9) mean_jaccard, min(jaccard) min_jaccard, bool_and(equal) all_equal FROM sd GROUP BY ROLLUP(dataset)")
def selection_difference_summary(spark, d):
    return contracts.selection_difference_summary(_chosen(spark, d), "dataset")


@query(f"WITH {W._ACTIONS} SELECT CAST(s AS INT) size, s IN (1,2,4) declared, count(query_id) queries FROM (SELECT unnest([1,2,4]) s) FULL JOIN actions ON size=s GROUP BY ALL")
def observed_sizes(spark, d):
    return contracts.observed_sizes(W._actions(spark, d), [1, 2, 4])


@query("SELECT dataset, column_name, cells, cells//4 blocks, cells//4*4 covered, cells-cells//4*4 left_out, cells//4>=3 eligible FROM (SELECT lower(trim(dataset)) dataset, column_name, count(*) cells FROM sample_records GROUP BY ALL)")
def partition_coverage(spark, d):
    return contracts.partition_coverage(table(spark, d, "sample_records").withColumn("dataset", F.lower(F.trim("dataset"))), ["dataset", "column_name"], 4)


_DELTAS = [("true_error_cells", "c"), ("correct_repairs", "r"), ("precision", "p"), ("f1", "f")]


@query(R._with(R._SUMMARY, ", a AS (SELECT scope, suite, dataset, c, r, p, f FROM summary WHERE method_name='base_repair'), b AS (SELECT scope, suite, dataset, max(c) c, max(r) r, max(p) p, max(f) f FROM summary WHERE method_name='llm_only' GROUP BY ALL), z AS (SELECT coalesce(a.scope,b.scope) AS scope, coalesce(a.suite,b.suite) suite, coalesce(a.dataset,b.dataset) dataset, a.scope IS NOT NULL ia, b.scope IS NOT NULL ib, a.c ac, b.c bc, a.r ar, b.r br, a.p ap, b.p bp, a.f af, b.f bf FROM a FULL JOIN b ON a.scope=b.scope AND a.suite=b.suite AND a.dataset=b.dataset) " + " UNION ALL ".join(f"SELECT scope, suite, dataset, '{n}' field, round(CAST(a{x} AS DOUBLE),9) AS \"before\", round(CAST(b{x} AS DOUBLE),9) AS \"after\", round(CAST(b{x} AS DOUBLE)-a{x},9) delta, CASE WHEN NOT ib THEN 'missing' WHEN NOT ia THEN 'extra' WHEN a{x} IS NOT DISTINCT FROM b{x} OR abs(a{x}-b{x})<=1e-12 THEN 'same' ELSE 'changed' END state FROM z" for n, x in _DELTAS)))
def metric_delta_rows(spark, d):
    """Every field of the base's summary beside that of asking every cell alone."""
    s, place = R._summary(spark, d), ["scope", "suite", "dataset"]
    names = [n for n, _ in _DELTAS]
    old = s.where("method_name = 'base_repair'").select(*place, *names)
    new = s.where("method_name = 'llm_only'").groupBy(*place).agg(*(F.max(n).alias(n) for n in names))
    x = contracts.metric_delta_rows(old, new, place, names)
    return x.select(*place, "field", *(F.round(c, 9).alias(c) for c in ("before", "after", "delta")), "state")


_LABELS = O.BASE + ", x AS (SELECT r.query_id, r.cell_id, r.clean_value, r.dirty_value, base_value, CASE WHEN decision='propose' AND coalesce(candidate,'')<>'' AND candidate<>r.dirty_value AND candidate<>base_value THEN 1 ELSE 0 END e, candidate FROM responses r JOIN base_values USING (dataset, col_idx))"


@query(R._with(_LABELS, "SELECT query_id, cell_id, CAST(base_value=clean_value AS INT) base_correct, CASE WHEN e=1 THEN CAST(candidate=clean_value AS INT) ELSE 0 END llm_correct, e executable, e*CASE WHEN e=1 THEN CAST(candidate=clean_value AS INT) ELSE 0 END*(1-CAST(base_value=clean_value AS INT)) helpful, e*CAST(base_value=clean_value AS INT)*(1-CASE WHEN e=1 THEN CAST(candidate=clean_value AS INT) ELSE 0 END) harmful FROM x"))
def calibration_labels(spark, d):
    r = O.responses(spark, d)
    actions = r.groupBy("query_id").agg(F.array_sort(F.collect_list("cell_id")).alias("cell_ids"))  # a query has a few cells
    known = O.found(spark, d).join(O.base_values(spark, d), ["dataset", "col_idx"])
    return contracts.calibration_labels(actions, r.select("query_id", "cell_id", "decision", F.col("candidate").alias("repair")), known)


@query("SELECT phase, CAST(sum(attempts) AS BIGINT) attempts, CAST(sum(coalesce(len(cell_ids),0)) AS BIGINT) cells, bool_and(attempts IS NOT NULL) complete FROM group_checkpoint WHERE phase IS NOT NULL GROUP BY phase")
def merged_usage(spark, d):
    """Sums of the counters of every delivery, held in maps."""
    t = table(spark, d, "group_checkpoint").where("phase is not null")
    usage = F.when(F.col("attempts").isNotNull(), F.create_map(F.lit("attempts"), F.col("attempts").cast("long"), F.lit("cells"), F.coalesce(F.when(F.col("cell_ids").isNotNull(), F.size("cell_ids")), F.lit(0)).cast("long")))
    x = contracts.merged_usage(t.select("phase", usage.alias("usage")), ["phase"], "usage")
    return x.select("phase", F.col("usage")["attempts"].cast("long").alias("attempts"), F.col("usage")["cells"].cast("long").alias("cells"), "complete")


@query()
def run_validation(spark, d):
    """A run's checks and how many rows each finds."""
    final = R._records(spark, d)
    return replay.validation({
        "deliveries_consistent": inconsistent_deliveries(spark, d), "evidence_borne_out": evidence_drift(spark, d), "identities_hold": groups_identities(spark, d), "latest_rows_unique": audit.repeated_identities(final, R._KEYS),
        "reported_metrics": replay.metric_mismatches(R._summary(spark, d), R._summary(spark, d), ["scope", "suite", "dataset", *R._SERIES], ["true_error_cells", "correct_repairs"], ["precision", "recall", "f1"]),
    })


def groups_identities(spark, d):
    from cellmend.plans.measures import group_cells

    return groups.identity_violations(groups.group_metrics(group_cells(spark, d)))


@query()
def run_bindings(spark, d):
    """Rows and digests of the tables a run is bound to, whatever the order of their rows."""
    return replay.bindings({t: table(spark, d, t) for t in ("clean", "error_log", "fd_components", "sample_records")})


# ---- choices, transfer, baselines

@query()
def selection_conformance(spark, d):
    """The greedy choice of each data set against its eager form and the optimum of a few of its queries; tested on random instances."""
    r = O.responses(spark, d).where("candidate is not null").withColumn("gain_units", S.exact_units(F.col("uplift")))
    return selection.conformance(r, ["dataset"])


@query()
def reselection(spark, d):
    """What a choice under a fifth of the cost changes when a tenth is given; every step is tested by itself."""
    r = O.responses(spark, d).where("candidate is not null").withColumn("gain_units", S.exact_units(F.col("uplift")))

    def chosen(share: float):
        ref = r.where("s = 1").groupBy("dataset").agg(F.bround(F.sum("query_cost") * share).cast("long").alias("budget"))
        return selection.select_queries(r.join(ref, "dataset"), ["dataset"])

    return contracts.selection_differences(chosen(0.2), chosen(0.1), ["dataset"])


@query(R._with(O.CANDIDATES, "SELECT dataset, s, count(*) candidates, count(*) FILTER (reason='accepted') accepted, count(*) FILTER (reason='accepted' AND candidate=clean_value AND fallback<>clean_value) rescued, count(*) FILTER (reason='accepted' AND candidate<>clean_value AND fallback=clean_value) harmed, count(*) FILTER (reason='accepted' AND (candidate=clean_value)=(fallback=clean_value)) neutral, count(*) FILTER (reason='fallback_decision') abstained, count(*) FILTER (reason='invalid_llm_output') unparsed FROM decided GROUP BY ALL"))
def transfer_outcomes(spark, d):
    """Answers of both kinds verified against another base: rescued, harmed, left as they were."""
    return verify.transfer_outcomes(verify.decide(O.candidates(spark, d)), ["dataset", "s"])


@query(R._with(O.BASE, "SELECT 'base_repair' method_name, cell_id, CASE WHEN row_idx%29=0 THEN dirty_value ELSE base_value END prediction, CASE WHEN row_idx%29=0 THEN 'failed' ELSE 'ok' END parse_status FROM found JOIN base_values USING (dataset, col_idx) UNION ALL SELECT 'llm_only', cell_id, CASE WHEN h<7 AND candidate<>dirty_value THEN candidate ELSE dirty_value END, CASE WHEN h=9 THEN 'provider_failure' WHEN h=8 THEN 'missing_item' WHEN h=7 THEN 'abstain' WHEN candidate='' THEN 'empty_repair' WHEN candidate=dirty_value THEN 'unchanged_dirty' ELSE 'ok' END FROM responses WHERE s=1"))
def full_baselines(spark, d):
    """The base alone and every cell's single answer alone, a record for each error cell of both."""
    known = O.found(spark, d).join(O.base_values(spark, d), ["dataset", "col_idx"])
    status = F.when(F.col("row_idx") % 29 == 0, "failed").otherwise("ok")
    base = known.select(F.lit("base_repair").alias("method_name"), "cell_id", verify.fallback_value(status, F.col("base_value"), F.col("dirty_value")).alias("prediction"), status.alias("parse_status"))
    own = verify.alone_record(*(F.col(c) for c in ("status", "parse_status", "decision", "candidate", "dirty_value")))
    r = O.responses(spark, d).where("s = 1")
    return base.unionByName(r.select(F.lit("llm_only").alias("method_name"), "cell_id", *(e.alias(n) for n, e in own.items())))


@query(R._with(O.BASE, "SELECT row_idx, held_by FROM (SELECT coalesce(d.row_idx, c.row_idx) row_idx, CASE WHEN c.row_idx IS NULL THEN 'dirty' ELSE 'clean' END held_by FROM (SELECT row_idx FROM dirty_part WHERE row_idx%7<>0) d FULL JOIN (SELECT row_idx FROM clean_part WHERE row_idx%5<>0) c ON c.row_idx=d.row_idx WHERE c.row_idx IS NULL OR d.row_idx IS NULL)"))
def unpaired_rows(spark, d):
    """Rows that only one of two tables holds, each of them lacking some of the other's."""
    dirty, clean = O.dirty_part(spark, d).where("row_idx % 7 <> 0"), O.clean_part(spark, d).where("row_idx % 5 <> 0")
    return cells.unpaired_rows(dirty, clean, "row_idx")


# ---- what must hold of choices and schedules that SQL can't make

@query(R._with(O.BASE, "SELECT DISTINCT dataset, true AS within, true AS once FROM found"))
def choice_holds(spark, d):
    """Per data set: whether the greedy choice keeps its budget and takes no query twice."""
    r = O.responses(spark, d).where("candidate is not null").withColumn("gain_units", S.exact_units(F.col("uplift")))
    ref = r.where("s = 1").groupBy("dataset").agg(F.bround(F.sum("query_cost") * 0.2).cast("long").alias("budget"))
    x = selection.select_queries(r.join(ref, "dataset"), ["dataset"]).groupBy("dataset").agg(F.sum("query_cost").alias("cost"), F.count("*").alias("n"), F.countDistinct("query_id").alias("k"))
    return x.join(ref, "dataset").select("dataset", (F.col("cost") <= F.col("budget")).alias("within"), (F.col("n") == F.col("k")).alias("once"))


@query("SELECT count(*) n, 0 low, count(*) - 1 high, count(*) different, max(c) turns FROM sample_records, (SELECT max(n) c FROM (SELECT count(*) n FROM sample_records GROUP BY column_name))")
def schedule_holds(spark, d):
    """The schedule numbers every query once, without gaps, and has as many turns as the largest condition has queries."""
    s = W.schedule(spark, d)
    return s.agg(F.count("*").alias("n"), F.min("logical_index").alias("low"), F.max("logical_index").alias("high"), F.countDistinct("logical_index").alias("different"), F.max("turn").cast("long").alias("turns"))


@query("WITH b AS (SELECT lower(trim(dataset)) ds, column_name, count(*)//4 n FROM sample_records GROUP BY ALL) SELECT ds, column_name, n*4 members, 0 stayed, n*4 different FROM b WHERE n >= 3")
def partition_holds(spark, d):
    """Every member of a condition's blocks goes to another block, each place of each block being taken once."""
    p = W.random_partition(spark, d)
    return p.groupBy("ds", "column_name").agg(F.count("*").alias("members"), F.sum((F.col("block") == F.col("partner_block")).cast("int")).alias("stayed"), F.countDistinct("partner_block", "member_index").alias("different"))
