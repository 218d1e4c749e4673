"""Queries of the repair workflow, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmend.functions import scalars as S
from cellmend.operators import audit, cells, gate, grouping, groups, ledger, metrics, profiles, rules, selection, statistics, verify
from cellmend.plans import overlays as O
from cellmend.operators.deliveries import canonical_digest
from cellmend.plans.registry import register
from cellmend.sources.tables import table

QUERIES, SQL, query = register()


def _with(cte: str, rest: str) -> str:
    return f"WITH {cte}\n{rest}"


# ---- cells

@query(_with(O.BASE, "SELECT suite, dataset, row_idx, col_idx, column_name, dirty_value, clean_value, cell_id FROM found"))
def cell_diff(spark, d):
    return O.found(spark, d)


@query(_with(O.BASE, "SELECT dataset, column_name, count(*) errors FROM found GROUP BY ALL"))
def cell_diff_counts(spark, d):
    return O.found(spark, d).groupBy("dataset", "column_name").agg(F.count("*").alias("errors"))


@query(_with(O.BASE, "SELECT cell_id, suite, dataset, row_idx, col_idx, column_name, dirty_value FROM found"))
def safe_cells(spark, d):
    return cells.online_view(O.found(spark, d)).select("cell_id", "suite", "dataset", "row_idx", "col_idx", "column_name", "dirty_value")


@query("SELECT CAST(row_id AS VARCHAR) resolved, count(*) n FROM clean GROUP BY 1")
def row_id_resolution(spark, d):
    t = table(spark, d, "clean")
    return t.groupBy(cells.row_id(t, "row_id").alias("resolved")).agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT dataset, TRY_CAST(row_id AS INT) row_idx, column_name, arg_max(error_type, log_id) error_type, count(*) entries FROM error_log GROUP BY ALL)
SELECT s.cell_id, s.sample_id, e.error_type FROM sample_records s LEFT JOIN e ON e.dataset = lower(trim(s.dataset)) AND e.row_idx = s.row_idx AND e.column_name = s.column_name
""")
def error_annotation_join(spark, d):
    own = table(spark, d, "sample_records").select("cell_id", "sample_id", F.lower(F.trim("dataset")).alias("dataset"), "row_idx", "column_name")
    return cells.annotate(own, table(spark, d, "error_log")).select("cell_id", "sample_id", "error_type")


@query(_with(O.BASE, """, bad AS (SELECT dataset, row_idx, list(col_idx) b FROM found WHERE dataset='part' GROUP BY ALL)
SELECT cell_id, concat_ws(' | ', """ + ", ".join(f"'{n}='||CASE WHEN col_idx={i} THEN '{cells.TARGET_MASK}' WHEN list_contains(b,{i}) THEN '{cells.OTHER_MASK}' ELSE p.{n} END" for i, n in enumerate(O.PART)) + ") masked FROM found JOIN bad USING (dataset,row_idx) JOIN dirty_part p USING (row_idx)"))
def masked_row(spark, d):
    return cells.masked_rows(O.dirty_part(spark, d), O.found(spark, d).where("dataset = 'part'"), "row_idx", O.PART)


# ---- scalars

_TEXT = "trim(regexp_replace(coalesce(right_value,''), '[\t\n ]+', ' ', 'g'), ' ')"


@query(f"SELECT log_id, {O.value_type_sql('v')} value_type, {O.collapsed_sql('m', 'v')} format FROM (SELECT log_id, v, {O.mapped_sql('v')} m FROM (SELECT log_id, {_TEXT} v FROM error_log))")
def value_type_and_format(spark, d):
    v = S.normalize_value(F.col("right_value"))
    return table(spark, d, "error_log").select("log_id", S.value_type(v).alias("value_type"), S.format_signature(v).alias("format"))


@query(f"SELECT {_TEXT} normalized, count(*) n FROM error_log GROUP BY 1")
def normalize_value(spark, d):
    return table(spark, d, "error_log").groupBy(S.normalize_value(F.col("right_value")).alias("normalized")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, greatest(1, length(t) - length(r) + CAST(ceil(octet_length(encode(r)) / 4.0) AS BIGINT)) tokens FROM (SELECT doc_id, coalesce(text,'') t, regexp_replace(coalesce(text,''), '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]', '', 'g') r FROM documents)""")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", S.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


@query("SELECT event_id, CASE WHEN x=0 THEN 'zero' WHEN x<0.25 THEN 'low' WHEN x<0.75 THEN 'medium' WHEN x<=1 THEN 'high' ELSE 'count_'||least(8, CAST(floor(log2(x+1)) AS BIGINT)) END bucket FROM (SELECT event_id, abs(value) x FROM events)")
def support_bucket(spark, d):
    return table(spark, d, "events").select("event_id", S.support_bucket(F.col("value")).alias("bucket"))


@query(r"SELECT cell_id, regexp_extract(cell_id, '^(.*:\d+):\d+$', 1) row_cluster, count(*) n FROM evidence_cells GROUP BY ALL")
def row_clusters(spark, d):
    return table(spark, d, "evidence_cells").groupBy("cell_id", S.row_cluster(F.col("cell_id")).alias("row_cluster")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, label, round(CASE WHEN sqrt(list_dot_product(e,e))=0 THEN 0 ELSE list_dot_product(e,c)/sqrt(list_dot_product(e,e))/sqrt(list_dot_product(c,c)) END, 4) cosine FROM (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings) JOIN (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] c FROM embeddings GROUP BY label) USING (label)")
def cosine_to_first(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return e.join(first, "label").select("vec_id", "label", F.round(grouping.cosine(F.col("embedding"), F.col("c")), 4).alias("cosine"))


# ---- rules and profiles

@query(_with(O.BASE, ", per AS (SELECT brand, ptype, count(*) c FROM dirty_part GROUP BY ALL) SELECT brand, CAST(sum(c) AS BIGINT) members, count(*) dependents, CAST(sum(c)*(sum(c)-1)//2 - sum(c*(c-1)//2) AS BIGINT) violation_pair_count FROM per GROUP BY brand HAVING count(*) > 1"))
def fd_groups(spark, d):
    return rules.violating_groups(O.dirty_part(spark, d), ["brand"], "ptype")


@query("SELECT o_custkey, CAST(sum(c) AS BIGINT) members, count(*) dependents, CAST(sum(c)*(sum(c)-1)//2 - sum(c*(c-1)//2) AS BIGINT) violation_pair_count FROM (SELECT o_custkey, o_orderpriority, count(*) c FROM orders GROUP BY ALL) GROUP BY o_custkey HAVING count(*) > 1")
def fd_groups_orders(spark, d):
    return rules.violating_groups(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query(_with(O.BASE, r""", g AS (SELECT brand, CAST(sum(c)*(sum(c)-1)//2 - sum(c*(c-1)//2) AS BIGINT) violation_pair_count FROM (SELECT brand, ptype, count(*) c FROM dirty_part GROUP BY ALL) GROUP BY brand HAVING count(*) > 1)
SELECT left(sha256('source'||chr(31)||'part'||chr(31)||'part_fd1'||chr(31)||brand), 24) component_id, cell_id, violation_pair_count FROM found JOIN dirty_part USING (row_idx) JOIN g USING (brand) WHERE dataset='part' AND col_idx IN (0,1)"""))
def fd_components(spark, d):
    return rules.violation_members(O.dirty_part(spark, d), O.found(spark, d).where("dataset = 'part'"), "row_idx", ["brand"], "ptype", O.PART, "source", "part", "part_fd1")


@query(_with(O.CANDIDATES, "SELECT cell_id, s, candidate, CAST(fd_before AS BIGINT) fd_before, CAST(fd_after AS BIGINT) fd_after, fd_after < fd_before fd_advantage FROM candidates WHERE dataset='part' AND candidate IS NOT NULL"))
def fd_conflicts_before_after(spark, d):
    return O.candidates(spark, d).where("dataset = 'part' and candidate is not null").select("cell_id", "s", "candidate", "fd_before", "fd_after", (F.col("fd_after") < F.col("fd_before")).alias("fd_advantage"))


@query("""
WITH m AS (SELECT DISTINCT component_id, unnest(cell_ids) cell_id FROM fd_components WHERE cell_ids IS NOT NULL)
SELECT s.cell_id, count(DISTINCT m.component_id) components FROM (SELECT DISTINCT cell_id FROM sample_records) s JOIN m USING (cell_id) GROUP BY 1
""")
def relevant_components(spark, d):
    members = table(spark, d, "fd_components").select("component_id", F.explode("cell_ids").alias("cell_id")).distinct()
    return table(spark, d, "sample_records").select("cell_id").distinct().join(members, "cell_id").groupBy("cell_id").agg(F.countDistinct("component_id").alias("components"))


_NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


@query(_with(O.BASE, f"SELECT dataset, column_name, count(*) rows_examined, count(*) FILTER (dirty_value<>'') nonempty_count, count(DISTINCT nullif(dirty_value,'')) unique_nonempty_count, round(1 - count(*) FILTER (dirty_value<>'')/count(*), 6) missing_fraction, round(count(*) FILTER (dirty_value<>'' AND regexp_matches(replace(dirty_value,',',''), '{_NUM}'))/count(*) FILTER (dirty_value<>''), 6) numeric_fraction FROM sound GROUP BY ALL"))
def column_profile(spark, d):
    return profiles.column_profile(O.sound(spark, d), ["dataset", "column_name"], "dirty_value")


@query(_with(O.BASE, "SELECT dataset, column_name, dirty_value, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset, column_name ORDER BY n DESC, dirty_value) rank FROM (SELECT dataset, column_name, dirty_value, count(*) n FROM sound WHERE dirty_value <> '' GROUP BY ALL)) WHERE rank <= 6"))
def top_values(spark, d):
    return profiles.ranked_values(O.sound(spark, d).where("dirty_value <> ''"), ["dataset", "column_name"], "dirty_value", 6)


@query(_with(O.CANDIDATES, "SELECT dataset, column_name, dominant_type, dominant_format FROM profile JOIN profile_f USING (dataset, column_name)"))
def verifier_profile_dominant(spark, d):
    return profiles.dominant(O.sound(spark, d), ["dataset", "column_name"], "dirty_value", "row_idx").select("dataset", "column_name", "dominant_type", "dominant_format")


@query(_with(O.BASE, """, w AS (SELECT p.*, coalesce(b, []) b FROM dirty_part p LEFT JOIN (SELECT row_idx, list(col_idx) b FROM found WHERE dataset='part' GROUP BY ALL) USING (row_idx)),
hits AS (SELECT f.cell_id, p.row_idx similar_row, """ + " + ".join(f"CAST(f.col_idx<>{i} AND NOT list_contains(t.b,{i}) AND NOT list_contains(p.b,{i}) AND t.{n}=p.{n} AS INT)" for i, n in enumerate(O.PART)) + """ matches FROM found f JOIN w t USING (row_idx) JOIN w p ON p.row_idx<>t.row_idx AND NOT list_contains(p.b, f.col_idx) WHERE dataset='part')
SELECT cell_id, similar_row, CAST(matches AS BIGINT) matches, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY matches DESC, similar_row) rank FROM hits WHERE matches > 0) WHERE rank <= 3"""))
def similar_rows_topk(spark, d):
    bad = O.found(spark, d).where("dataset = 'part'")
    return profiles.similar_rows(O.dirty_part(spark, d), bad, bad, "row_idx", O.PART, 3)


@query(_with(O.BASE, "SELECT cell_id, base_value prediction, base_value = clean_value correct FROM found JOIN base_values USING (dataset, col_idx)"))
def base_majority(spark, d):
    return O.found(spark, d).join(O.base_values(spark, d), ["dataset", "col_idx"]).select("cell_id", F.col("base_value").alias("prediction"), (F.col("base_value") == F.col("clean_value")).alias("correct"))


@query(_with(O.BASE, """, c AS (SELECT f.cell_id, v.dirty_value candidate, count(*)*1.0 support FROM found f JOIN sound v ON v.dataset=f.dataset AND v.col_idx=f.col_idx WHERE f.dataset='part' AND f.col_idx=1 GROUP BY ALL),
x AS (SELECT f.cell_id, s.ptype candidate, count(*) n FROM found f JOIN dirty_part t USING (row_idx) JOIN dirty_part s ON s.brand=t.brand JOIN sound o ON o.dataset='part' AND o.col_idx=1 AND o.row_idx=s.row_idx WHERE f.dataset='part' AND f.col_idx=1 GROUP BY ALL),
t AS (SELECT cell_id, candidate, support/sum(support) OVER (PARTITION BY cell_id) dom, coalesce(n,0)/greatest(1,sum(coalesce(n,0)) OVER (PARTITION BY cell_id)) vic FROM c LEFT JOIN x USING (cell_id, candidate))
SELECT cell_id, candidate, round((dom+vic)/2, 9) support, CAST(dom>0 AS INT)+CAST(vic>0 AS INT) source_count, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY round((dom+vic)/2, 9) DESC, candidate) AS INT) AS rank FROM t QUALIFY rank <= 10"""))
def candidate_support_rank(spark, d):
    """Two published sources of base candidates: how frequent a value is in the column, and given the neighbour's value."""
    bad = O.found(spark, d).where("dataset = 'part' and col_idx = 1").select("cell_id", "row_idx")
    good = O.sound(spark, d).where("dataset = 'part' and col_idx = 1").select("row_idx", F.col("dirty_value").alias("candidate"))
    part = O.dirty_part(spark, d).select("row_idx", "brand")
    domain = good.groupBy("candidate").agg(F.count("*").alias("n"))
    total = domain.agg(F.sum("n").alias("total"))  # one row
    domain = domain.join(F.broadcast(total)).select("candidate", (F.col("n") / F.col("total")).alias("dom"))
    vicinity = good.join(part, "row_idx").groupBy("brand", "candidate").agg(F.count("*").alias("v"))
    sums = vicinity.groupBy("brand").agg(F.sum("v").alias("all_v"))
    near = vicinity.join(sums, "brand").join(domain, "candidate").select("brand", "candidate", "dom", (F.col("v") / F.col("all_v")).alias("vic"))
    # a value never met beside this brand can be among the ten best only if it is among the ten most frequent
    frequent = domain.orderBy(F.desc(F.round("dom", 9)), "candidate").limit(10)
    far = bad.join(part, "row_idx").select("brand").distinct().join(F.broadcast(frequent)).join(near.select("brand", "candidate"), ["brand", "candidate"], "left_anti").withColumn("vic", F.lit(0.0))
    support = F.round((F.col("dom") + F.col("vic")) / 2, 9)
    by_brand = near.unionByName(far.select("brand", "candidate", "dom", "vic")).select("brand", "candidate", support.alias("support"), (F.lit(1) + (F.col("vic") > 0).cast("int")).alias("source_count"))
    by_brand = by_brand.withColumn("rank", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("support"), "candidate"))).where("rank <= 10")
    return bad.join(part, "row_idx").join(by_brand, "brand").select("cell_id", "candidate", "support", "source_count", "rank")


# ---- verification

@query(_with(O.CANDIDATES, "SELECT cell_id, s, reason, reason='accepted' accepted, CASE WHEN reason IN ('accepted','verification_score_below_threshold') THEN round(sc,9) ELSE 0 END score, CASE WHEN reason='accepted' THEN candidate ELSE fallback END final_prediction FROM decided"))
def verifier_decision(spark, d):
    return verify.decide(O.candidates(spark, d)).select("cell_id", "s", "reason", "accepted", "score", "final_prediction")


@query(_with(O.CANDIDATES, ", r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY CAST(reason<>'accepted' AS INT), -uplift, query_cost, query_size, query_id) k, count(*) OVER (PARTITION BY cell_id) candidates, sum(CAST(reason='accepted' AS INT)) OVER (PARTITION BY cell_id) a FROM decided) SELECT cell_id, CASE WHEN reason='accepted' THEN query_id END query_id, CASE WHEN reason='accepted' THEN candidate ELSE fallback END final_prediction, CASE WHEN reason='accepted' THEN 'llm' ELSE 'base' END final_source, candidates, CAST(a AS BIGINT) accepted_candidates FROM r WHERE k=1"))
def arbitration(spark, d):
    return verify.arbitrate(verify.decide(O.candidates(spark, d)))


@query(_with(O.CANDIDATES, "SELECT reason, count(*) n FROM decided GROUP BY 1"))
def rejection_reasons(spark, d):
    return verify.decide(O.candidates(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


@query(_with(O.CANDIDATES, ", r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY CAST(reason<>'accepted' AS INT), -uplift, query_cost, query_size, query_id) k FROM decided) SELECT suite, dataset, cell_id, clean_value, CASE WHEN reason='accepted' THEN candidate ELSE fallback END prediction, CASE WHEN reason='accepted' THEN candidate ELSE fallback END = clean_value correct_repair FROM r WHERE k=1"))
def final_records(spark, d):
    c = O.found(spark, d).select("suite", "dataset", "cell_id", "clean_value")
    return c.join(arbitration(spark, d).select("cell_id", F.col("final_prediction").alias("prediction")), "cell_id").select("suite", "dataset", "cell_id", "clean_value", "prediction", (F.col("prediction") == F.col("clean_value")).alias("correct_repair"))


# ---- ledgers

_CP = "@query_id"


def _checkpoint(spark, d):
    """Deliveries with a query, digests in one form; a blank request hash is none."""
    own = {c: canonical_digest(F.col(c)) for c in ("prompt_hash", "provider_request_hash")}
    own["provider_request_hash"] = F.when(own["provider_request_hash"] != "", own["provider_request_hash"])
    return table(spark, d, "group_checkpoint").where("query_id is not null").withColumns({"q": canonical_digest(F.col("query_id")), **own})


@query(f"SELECT q, delivery_id, status, attempts FROM (SELECT {_CP} q, *, row_number() OVER (PARTITION BY {_CP} ORDER BY received_at DESC NULLS LAST, delivery_id DESC) k FROM group_checkpoint WHERE query_id IS NOT NULL) WHERE k=1")
def latest_ledger_row(spark, d):
    return ledger.latest(_checkpoint(spark, d).select("q", "received_at", "delivery_id", "status", "attempts"), ["q"], ["received_at", "delivery_id"]).select("q", "delivery_id", "status", "attempts")


@query(f"SELECT q, delivery_id, status, batch_id FROM (SELECT {_CP} q, *, row_number() OVER (PARTITION BY {_CP} ORDER BY CASE WHEN status='success' THEN 0 ELSE 1 END, batch_id, delivery_id DESC) k FROM group_checkpoint WHERE query_id IS NOT NULL) WHERE k=1")
def response_bank(spark, d):
    return ledger.response_bank(_checkpoint(spark, d).select("q", "delivery_id", "status", "batch_id"), ["q"], F.col("batch_id"), F.col("delivery_id"))


@query(f"SELECT q, delivery_id, attempts, latency_seconds FROM (SELECT {_CP} q, *, row_number() OVER (PARTITION BY {_CP} ORDER BY delivery_id) k FROM group_checkpoint WHERE query_id IS NOT NULL) WHERE k=1")
def physical_dedup(spark, d):
    return ledger.first_use(_checkpoint(spark, d).select("q", "delivery_id", "attempts", "latency_seconds"), "q", ["delivery_id"])


@query("SELECT phase, count(*) physical_rows, count(DISTINCT @query_id) identities, count(DISTINCT CASE WHEN status='success' THEN @query_id END) resolved, CAST(sum(attempts) AS BIGINT) attempts, CAST(sum(attempts-1) AS BIGINT) retries, count(*) FILTER (cache_hit) cache_hits, round(sum(latency_seconds), 3) latency_seconds FROM group_checkpoint GROUP BY ALL")
def api_cost_phases(spark, d):
    t, q = table(spark, d, "group_checkpoint"), canonical_digest(F.col("query_id"))
    return t.groupBy("phase").agg(F.count("*").alias("physical_rows"), F.countDistinct(q).alias("identities"), F.countDistinct(F.when(F.col("status") == "success", q)).alias("resolved"), F.sum("attempts").alias("attempts"), F.sum(F.col("attempts") - 1).alias("retries"), F.sum(F.when(F.col("cache_hit"), 1).otherwise(0)).alias("cache_hits"), F.round(F.sum("latency_seconds"), 3).alias("latency_seconds"))


@query("SELECT coalesce(CAST(sum(CASE WHEN status='success' THEN t END) AS BIGINT),0) known, count(*) FILTER (status<>'success' OR status IS NULL) unknown, CAST(coalesce(sum(CASE WHEN status='success' THEN t END),0) + count(*) FILTER (status<>'success' OR status IS NULL)*1024 AS BIGINT) debit FROM (SELECT status, greatest(1, CAST(ceil(octet_length(encode(r))/4.0) AS BIGINT) + length(x)-length(r)) t FROM (SELECT status, coalesce(response_text,'') x, regexp_replace(coalesce(response_text,''), '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}]', '', 'g') r FROM group_checkpoint))")
def safety_debit(spark, d):
    t = table(spark, d, "group_checkpoint").select("status", S.token_estimate(F.coalesce("response_text", F.lit(""))).alias("t"))
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    known, unknown = F.coalesce(F.sum(F.when(ok, F.col("t"))), F.lit(0)), F.sum((~ok).cast("int"))
    return t.agg(known.alias("known"), unknown.alias("unknown"), (known + unknown * 1024).alias("debit"))


@query(f"SELECT q, n_prompt_hash, n_provider_request_hash FROM (SELECT {_CP} q, count(DISTINCT @prompt_hash) n_prompt_hash, count(DISTINCT nullif(@provider_request_hash, '')) n_provider_request_hash FROM group_checkpoint WHERE query_id IS NOT NULL GROUP BY 1) WHERE n_prompt_hash>1 OR n_provider_request_hash>1")
def identity_audit(spark, d):
    return audit.more_than_one(_checkpoint(spark, d), ["q"], ["prompt_hash", "provider_request_hash"])


@query(f"WITH r AS (SELECT DISTINCT {_CP} q FROM group_checkpoint WHERE query_id IS NOT NULL) SELECT q FROM r WHERE q NOT IN (SELECT {_CP} FROM group_checkpoint WHERE query_id IS NOT NULL AND status IN ('success','ok','completed'))")
def union_plan_anti_join(spark, d):
    t = _checkpoint(spark, d)
    return ledger.still_to_ask(t.select("q").distinct(), t, ["q"])


@query(r"""SELECT delivery_id, status, reason FROM (SELECT *, CASE WHEN status IS NULL OR status<>'success' THEN 'not_successful' WHEN parse_status IS NULL OR parse_status NOT IN ('ok','partial') THEN 'not_parsed' WHEN provider_request_hash IS NULL OR trim(provider_request_hash)='' THEN 'no_request_hash' END reason FROM group_checkpoint) WHERE reason IS NOT NULL""")
def reuse_rejections(spark, d):
    reason = F.when(~F.coalesce(F.col("status") == "success", F.lit(False)), "not_successful").when(~F.coalesce(F.col("parse_status").isin("ok", "partial"), F.lit(False)), "not_parsed").when(F.coalesce(F.trim("provider_request_hash"), F.lit("")) == "", "no_request_hash")
    return table(spark, d, "group_checkpoint").withColumn("reason", reason).where("reason is not null").select("delivery_id", "status", "reason")


@query("SELECT phase, status, parse_status, count(*) n FROM group_checkpoint GROUP BY ALL")
def phase_states(spark, d):
    return table(spark, d, "group_checkpoint").groupBy("phase", "status", "parse_status").agg(F.count("*").alias("n"))


@query("""SELECT delivery_id, CAST(json_extract(r, '$.cell') AS INT) AS cell, json_extract_string(r, '$.repair') AS repair, CAST(json_extract_string(r, '$.confidence') AS DOUBLE) AS confidence FROM (SELECT delivery_id, unnest(CAST(json_extract(response_text, '$.repairs') AS JSON[])) r FROM group_checkpoint WHERE json_valid(response_text))""")
def response_items(spark, d):
    """Items of the stored answers; texts that are no whole JSON have none."""
    shape = "struct<query_id:string,repairs:array<struct<cell:int,repair:string,confidence:double>>>"
    x = table(spark, d, "group_checkpoint").select("delivery_id", F.from_json("response_text", shape).alias("j"))
    return x.select("delivery_id", F.inline("j.repairs")).select("delivery_id", "cell", "repair", "confidence")


@query()
def parse_repairs(spark, d):
    """Stored answers brought to cells of their query and parsed with salvage; tested against hand-made answers."""
    t = table(spark, d, "group_checkpoint").select("delivery_id", "query_id", "response_text", "cell_ids")
    parsed = ledger.parse_responses(t)
    return parsed.select("delivery_id", F.col("parsed.parse_status").alias("parse_status"), F.size("parsed.items").alias("items"), F.size("parsed.missing").alias("missing"), F.size("parsed.invalid").alias("invalid"))


# ---- quality

_FR = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method_name, scenario, backend, budget_share, group_size_variant, cell_id ORDER BY row_index DESC) k FROM final_records) WHERE k=1"
_KEYS = ["method_name", "scenario", "backend", "budget_share", "group_size_variant", "cell_id"]
_SUMMARY = f"""
fr AS ({_FR}), per AS (SELECT method_name, scenario, backend, budget_share, group_size_variant, suite, dataset, count(*) c, count(*) FILTER (coalesce(parse_status,'') LIKE 'ok%') v, count(*) FILTER (coalesce(parse_status,'') LIKE 'ok%' AND correct_repair) r FROM fr GROUP BY ALL),
pr AS (SELECT *, CASE WHEN v=0 THEN 0 ELSE r/v END p, CASE WHEN c=0 THEN 0 ELSE r/c END q FROM per), pf AS (SELECT *, CASE WHEN p+q=0 THEN 0 ELSE 2*p*q/(p+q) END f FROM pr),
mi AS (SELECT method_name, scenario, backend, budget_share, group_size_variant, 'ALL' suite, 'MICRO' dataset, sum(c) c, sum(v) v, sum(r) r, CASE WHEN sum(v)=0 THEN 0 ELSE sum(r)/sum(v) END p, sum(r)/sum(c) q FROM per GROUP BY ALL),
summary AS (SELECT method_name, scenario, backend, budget_share, group_size_variant, suite, dataset, 'dataset' AS scope, c, v, r, p, q, f FROM pf
UNION ALL SELECT method_name, scenario, backend, budget_share, group_size_variant, suite, dataset, 'micro', c, v, r, p, q, CASE WHEN p+q=0 THEN 0 ELSE 2*p*q/(p+q) END FROM mi
UNION ALL SELECT method_name, scenario, backend, budget_share, group_size_variant, 'ALL', 'MACRO', 'macro', sum(c), sum(v), sum(r), avg(p), avg(q), avg(f) FROM pf GROUP BY ALL)"""
_ROUNDED = "CAST(c AS BIGINT) true_error_cells, CAST(v AS BIGINT) valid_predictions, CAST(r AS BIGINT) correct_repairs, round(p,9) AS precision, round(q,9) recall, round(f,9) f1"


def _records(spark, d):
    keep = table(spark, d, "final_records").select(*_KEYS, "row_index", "suite", "dataset", "parse_status", "correct_repair", "prediction", "clean_value", "final_source")
    return ledger.latest(keep, _KEYS, ["row_index"])


def _summary(spark, d):
    return metrics.summarize(_records(spark, d), F.coalesce("parse_status", F.lit("")).startswith("ok"), F.coalesce("correct_repair", F.lit(False)))


@query(_with(_SUMMARY, f"SELECT method_name, scenario, backend, budget_share, group_size_variant, suite, dataset, scope, {_ROUNDED} FROM summary"))
def metrics_summary(spark, d):
    return _summary(spark, d).select(*metrics.SERIES, "suite", "dataset", "scope", *metrics.COUNTS, *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(_with(_SUMMARY, ", b AS (SELECT scope, suite, dataset, p bp, q bq, f bf FROM summary WHERE method_name='base_repair') SELECT method_name, backend, budget_share, group_size_variant, scope, suite, dataset, round(p-bp,9) precision_delta, round(q-bq,9) recall_delta, round(f-bf,9) f1_delta FROM summary JOIN b USING (scope, suite, dataset) WHERE method_name<>'base_repair'"))
def metric_deltas(spark, d):
    x = metrics.deltas(_summary(spark, d), "base_repair", ["precision", "recall", "f1"])
    return x.select("method_name", "backend", "budget_share", "group_size_variant", "scope", "suite", "dataset", *(F.round(f"{c}_delta", 9).alias(f"{c}_delta") for c in ("precision", "recall", "f1")))


@query(_with(_SUMMARY, "SELECT suite, dataset, scope, round(max(CASE WHEN method_name='base_repair' THEN f END),9) base_repair, round(max(CASE WHEN method_name='llm_only' THEN f END),9) llm_only, round(max(CASE WHEN method_name='group_router' THEN f END),9) group_router FROM summary GROUP BY ALL"))
def f1_matrix_pivot(spark, d):
    wide = _summary(spark, d).groupBy("suite", "dataset", "scope").pivot("method_name", ["base_repair", "llm_only", "group_router"]).agg(F.max("f1"))
    return wide.select("suite", "dataset", "scope", *(F.round(c, 9).alias(c) for c in ("base_repair", "llm_only", "group_router")))


@query(_with(_SUMMARY, """, pts AS (SELECT s.backend, s.group_size_variant, s.scope, s.suite, s.dataset, s.budget_share x, s.f y, b.f a FROM summary s JOIN (SELECT scope, suite, dataset, f FROM summary WHERE method_name='base_repair') b USING (scope, suite, dataset) WHERE s.method_name='group_router' AND s.budget_share > 0),
allp AS (SELECT backend, group_size_variant, scope, suite, dataset, x, y FROM pts UNION ALL SELECT DISTINCT backend, group_size_variant, scope, suite, dataset, 0.0, a FROM pts),
st AS (SELECT *, lag(x) OVER w lx, lag(y) OVER w ly FROM allp WINDOW w AS (PARTITION BY backend, group_size_variant, scope, suite, dataset ORDER BY x))
SELECT backend, group_size_variant, scope, suite, dataset, round(sum((x-lx)*(y+ly)/2)/0.3, 9) area, count(*) points FROM st GROUP BY ALL HAVING abs(max(x)-0.3)<=1e-12"""))
def aubc(spark, d):
    s = _summary(spark, d)
    place = ["scope", "suite", "dataset"]
    base = s.where("method_name = 'base_repair'").select(*place, F.col("f1").alias("anchor"))
    pts = s.where("method_name = 'group_router' and budget_share > 0").join(base, place)
    x = metrics.budget_curve_area(pts, ["backend", "group_size_variant", *place], "budget_share", "f1", "anchor", 0.3)
    return x.select("backend", "group_size_variant", *place, F.round("area", 9).alias("area"), "points")


@query("SELECT method_name, scenario, backend, budget_share, group_size_variant, cell_id, count(*) n FROM final_records GROUP BY ALL HAVING count(*)>1")
def record_audit_duplicates(spark, d):
    return audit.repeated_identities(table(spark, d, "final_records"), _KEYS)


@query("WITH a AS (SELECT DISTINCT cell_id FROM final_records WHERE method_name='base_repair'), b AS (SELECT DISTINCT cell_id FROM final_records WHERE method_name='llm_only') SELECT cell_id, 'missing' state FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT cell_id, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def coverage_except(spark, d):
    t = table(spark, d, "final_records")
    return audit.coverage(t.where("method_name = 'base_repair'"), t.where("method_name = 'llm_only'"), ["cell_id"])


_DIFF = "WITH a AS (SELECT cell_id, arg_max({k: prediction}, row_index) p FROM final_records WHERE method_name='llm_only' GROUP BY 1), b AS (SELECT cell_id, arg_max({k: prediction}, row_index) p FROM final_records_replay WHERE method_name='llm_only' GROUP BY 1)".replace("{k: prediction}", "{'x': prediction, 's': parse_status}")


@query(_DIFF + " SELECT count(*) FILTER (a.p IS NOT NULL AND b.p IS NOT NULL) matched, count(*) FILTER (b.p IS NULL) only_first, count(*) FILTER (a.p IS NULL) only_second, count(*) FILTER (a.p IS NOT NULL AND b.p IS NOT NULL AND a.p.x IS DISTINCT FROM b.p.x) prediction_changed, count(*) FILTER (a.p IS NOT NULL AND b.p IS NOT NULL AND a.p.s IS DISTINCT FROM b.p.s) parse_status_changed, 'llm_only' AS m FROM a FULL JOIN b USING (cell_id)")
def ledger_diff(spark, d):
    side = lambda n: ledger.latest(table(spark, d, n).where("method_name = 'llm_only'").select(F.lit("llm_only").alias("m"), "cell_id", "row_index", "prediction", "parse_status"), ["m", "cell_id"], ["row_index"])
    return audit.difference_counters(side("final_records"), side("final_records_replay"), ["m", "cell_id"], ["prediction", "parse_status"], ["m"])


_WHOLE = ["suite", "dataset", *_KEYS]
_FIELDS = ["prediction", "parse_status", "final_source", "correct_repair"]
_GROUP = ["method_name", "scenario", "backend", "budget_share", "group_size_variant", "suite", "dataset"]
# fixed values: texts that mean yes; the copies write verdicts and budgets in notations of their own
_YES = ["1", "true", "yes", "y"]
_OWN = f"(SELECT * REPLACE (round(budget_share, 9) AS budget_share, lower(CAST(correct_repair AS VARCHAR)) IN ({', '.join(map(repr, _YES))}) AS correct_repair) FROM"
_SIDE = f"SELECT {', '.join(_WHOLE)}, arg_max({{{', '.join(f"'{f}': {f}" for f in _FIELDS)}}}, row_index) p FROM {_OWN}"
_GROUPS = f"WITH a AS ({_SIDE} final_records) GROUP BY ALL), b AS ({_SIDE} final_records_replay) GROUP BY ALL), u AS (SELECT {', '.join(_WHOLE)}, any_value(x) x, any_value(y) y FROM (SELECT {', '.join(_WHOLE)}, p x, NULL y FROM a UNION ALL SELECT {', '.join(_WHOLE)}, NULL, p FROM b) GROUP BY ALL), m AS (SELECT *, x IS NOT NULL AND y IS NOT NULL both_, coalesce(x.correct_repair, false) was, coalesce(y.correct_repair, false) now_ FROM u)"


@query(f"{_GROUPS} SELECT {', '.join(_GROUP)}, count(*) FILTER (x IS NOT NULL) first_rows, count(*) FILTER (y IS NOT NULL) second_rows, count(*) FILTER (both_) matched, count(*) FILTER (y IS NULL) only_first, count(*) FILTER (x IS NULL) only_second, " + ", ".join(f"count(*) FILTER (both_ AND x.{f} IS DISTINCT FROM y.{f}) {f}_changed" for f in _FIELDS) + ", count(*) FILTER (both_ AND NOT was AND now_) newly_right, count(*) FILTER (both_ AND was AND NOT now_) lost_right, count(*) FILTER (both_ AND x IS DISTINCT FROM y) any_changed FROM m GROUP BY ALL")
def ledger_diff_groups(spark, d):
    """Both whole ledgers on their full key, null keys being equal, counted per method, scenario, backend, budget, variant and data set."""
    own = {"budget_share": F.round("budget_share", 9), "correct_repair": F.lower(F.col("correct_repair").cast("string")).isin(*_YES)}
    side = lambda n: ledger.latest(table(spark, d, n).withColumns(own).select(*_WHOLE, "row_index", *_FIELDS), _WHOLE, ["row_index"])
    return audit.group_counters(side("final_records"), side("final_records_replay"), _WHOLE, _FIELDS, "correct_repair", _GROUP)


def _pair(spark, d):
    r = _records(spark, d)
    ok = F.coalesce("correct_repair", F.lit(False)) & F.coalesce("parse_status", F.lit("")).startswith("ok")
    a = r.where("method_name = 'base_repair'").groupBy("suite", "dataset", "cell_id").agg(F.max(ok).alias("base_ok"))
    b = r.where("method_name = 'group_router' and budget_share = 0.2").groupBy("suite", "dataset", "cell_id").agg(F.max(ok).alias("method_ok"))
    return a.join(b, ["suite", "dataset", "cell_id"])


_PAIR = f"fr AS ({_FR}), a AS (SELECT suite, dataset, cell_id, bool_or(coalesce(correct_repair,false) AND coalesce(parse_status,'') LIKE 'ok%') x FROM fr WHERE method_name='base_repair' GROUP BY ALL), b AS (SELECT suite, dataset, cell_id, bool_or(coalesce(correct_repair,false) AND coalesce(parse_status,'') LIKE 'ok%') y FROM fr WHERE method_name='group_router' AND budget_share=0.2 GROUP BY ALL)"


@query(_with(_PAIR, "SELECT suite, dataset, count(*) FILTER (x AND y) n11, count(*) FILTER (x AND NOT y) n10, count(*) FILTER (NOT x AND y) n01, count(*) FILTER (NOT x AND NOT y) n00 FROM a JOIN b USING (suite, dataset, cell_id) GROUP BY ALL"))
def paired_transitions(spark, d):
    return metrics.quadrants(_pair(spark, d), F.col("base_ok"), F.col("method_ok"), [["suite", "dataset"]])


_SERIES = ["method_name", "scenario", "backend", "budget_share", "group_size_variant"]
_OK = "coalesce(correct_repair,false) AND coalesce(parse_status,'') LIKE 'ok%'"


@query(_with(f"fr AS ({_FR}), a AS (SELECT suite, dataset, cell_id, bool_or({_OK}) x FROM fr WHERE method_name='base_repair' GROUP BY ALL), b AS (SELECT {', '.join(_SERIES)}, suite, dataset, cell_id, bool_or({_OK}) y FROM fr WHERE method_name<>'base_repair' GROUP BY ALL)", f"SELECT {', '.join(_SERIES)}, suite, dataset, count(*) FILTER (x AND y) n11, count(*) FILTER (x AND NOT y) n10, count(*) FILTER (NOT x AND y) n01, count(*) FILTER (NOT x AND NOT y) n00 FROM a JOIN b USING (suite, dataset, cell_id) GROUP BY ALL"))
def paired_transitions_series(spark, d):
    """Every method, back end, budget and variant by itself against the base."""
    cell = ["suite", "dataset", "cell_id"]
    ok = F.coalesce("correct_repair", F.lit(False)) & F.coalesce("parse_status", F.lit("")).startswith("ok")
    r, base = _records(spark, d), F.col("method_name") == "base_repair"
    a = r.where(base).groupBy(*cell).agg(F.max(ok).alias("base_ok"))
    b = r.where(~base).groupBy(*_SERIES, *cell).agg(F.max(ok).alias("method_ok"))
    n = lambda x, y: F.sum(F.when((F.col("base_ok") == x) & (F.col("method_ok") == y), 1).otherwise(0)).alias(f"n{int(x)}{int(y)}")
    return a.join(b, cell).groupBy(*_SERIES, "suite", "dataset").agg(n(True, True), n(True, False), n(False, True), n(False, False))


@query(_with(_SUMMARY, ", b AS (SELECT suite, dataset, f bf FROM summary WHERE method_name='base_repair' AND scope='dataset') SELECT method_name, backend, budget_share, CAST(sum(CAST(f-bf>1e-12 AS INT)) AS BIGINT) wins, CAST(sum(CAST(abs(f-bf)<=1e-12 AS INT)) AS BIGINT) ties, CAST(sum(CAST(f-bf< -1e-12 AS INT)) AS BIGINT) losses FROM summary JOIN b USING (suite, dataset) WHERE scope='dataset' AND method_name<>'base_repair' GROUP BY ALL"))
def win_tie_loss(spark, d):
    x = metrics.deltas(_summary(spark, d).where("scope = 'dataset'"), "base_repair", ["f1"])
    return metrics.win_tie_loss(x, ["method_name", "backend", "budget_share"], "f1_delta")


_EV = "SELECT suite, dataset, coalesce(baran_correct,0)=1 b, coalesce(llm_correct,0)=1 l FROM evidence_cells"


@query(f"WITH e AS ({_EV}) SELECT CASE WHEN grouping(suite)=1 THEN 'ALL' ELSE suite END suite, CASE WHEN grouping(dataset)=1 THEN 'ALL' ELSE dataset END dataset, count(*) FILTER (b AND l) n11, count(*) FILTER (b AND NOT l) n10, count(*) FILTER (NOT b AND l) n01, count(*) FILTER (NOT b AND NOT l) n00 FROM e GROUP BY GROUPING SETS ((suite, dataset), (suite), ())")
def quadrants_grouping_sets(spark, d):
    return metrics.quadrants(table(spark, d, "evidence_cells"), F.coalesce(F.col("baran_correct") == 1, F.lit(False)), F.coalesce(F.col("llm_correct") == 1, F.lit(False)), [["suite", "dataset"], ["suite"], []])


@query(f"WITH e AS ({_EV}) SELECT suite, dataset, round(avg(CAST(b AS INT)),9) base_accuracy, round(avg(CAST(l AS INT)),9) llm_accuracy, round(avg(CAST(b OR l AS INT)),9) union_accuracy, round(avg(CAST(l AND NOT b AS INT)),9) rescue_rate, round(avg(CAST(b AND NOT l AS INT)),9) harm_rate, round(avg(CAST(b<>l AS INT)),9) disagreement, round(avg(CAST(l AS INT)-CAST(b AS INT)),9) net FROM e GROUP BY ALL")
def complementarity_rates(spark, d):
    q = metrics.quadrants(table(spark, d, "evidence_cells"), F.coalesce(F.col("baran_correct") == 1, F.lit(False)), F.coalesce(F.col("llm_correct") == 1, F.lit(False)), [["suite", "dataset"]])
    return metrics.complementarity_rates(q).drop(*metrics.QUADRANTS)


def _tests(spark, d):
    q = quadrants_grouping_sets(spark, d).where("dataset <> 'ALL'")
    return q.withColumn("p", statistics.mcnemar(F.col("n10"), F.col("n01")))


@query(f"""WITH e AS ({_EV}), q AS (SELECT suite, dataset, count(*) FILTER (b AND NOT l) n10, count(*) FILTER (NOT b AND l) n01 FROM e GROUP BY ALL),
t AS (SELECT *, CASE WHEN n10=n01 THEN 1.0 ELSE least(1.0, 2*list_sum(list_transform(range(0, least(n10,n01)+1), lambda i: exp(lgamma(n10+n01+1)-lgamma(i+1)-lgamma(n10+n01-i+1)-(n10+n01)*ln(2))))) END p FROM q),
s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY suite) - row_number() OVER (PARTITION BY suite ORDER BY p, dataset) + 1)*p) st, row_number() OVER (PARTITION BY suite ORDER BY p, dataset) k FROM t)
SELECT suite, dataset, n10, n01, round(p,7) p, round(max(st) OVER (PARTITION BY suite ORDER BY k),7) p_holm FROM s""")
def mcnemar_holm(spark, d):
    x = metrics.holm(_tests(spark, d), ["suite"], "p", "dataset")
    return x.select("suite", "dataset", "n10", "n01", F.round("p", 7).alias("p"), F.round("p_holm", 7).alias("p_holm"))


@query("SELECT suite, n, p50, p90, p95 FROM (SELECT suite, count(*) n, " + ", ".join(f"list_sort(list(llm_observed_total_tokens))[greatest(1, CAST(ceil({p}*count(*)) AS BIGINT))] p{n}" for p, n in ((0.5, 50), (0.9, 90), (0.95, 95))) + " FROM evidence_cells WHERE llm_observed_total_tokens IS NOT NULL GROUP BY suite)")
def nearest_rank_percentile(spark, d):
    return metrics.nearest_rank(table(spark, d, "evidence_cells"), ["suite"], "llm_observed_total_tokens", [0.5, 0.9, 0.95])


@query("""SELECT dataset, state, count(*) n FROM (SELECT dataset, CASE WHEN lower(trim(coalesce(llm_status,''))) NOT IN ('success','ok','completed') THEN 'provider_failure' WHEN coalesce(llm_prediction,'')='' THEN 'empty' WHEN llm_prediction=coalesce(dirty_value,'') THEN 'unchanged' ELSE 'valid' END state FROM evidence_cells) GROUP BY ALL""")
def failure_states(spark, d):
    state = groups.failure_state(F.col("llm_status"), F.lit("ok"), F.lit("propose"), F.col("llm_prediction"), F.col("dirty_value"))
    return table(spark, d, "evidence_cells").groupBy("dataset", state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT base_family, CAST(sum(llm_observed_total_tokens) AS BIGINT) tokens, count(*) calls, count(*) FILTER (llm_observed_total_tokens IS NULL) unknown FROM evidence_cells GROUP BY ALL")
def cost_by_slice(spark, d):
    return table(spark, d, "evidence_cells").groupBy("base_family").agg(F.sum("llm_observed_total_tokens").alias("tokens"), F.count("*").alias("calls"), F.sum(F.col("llm_observed_total_tokens").isNull().cast("int")).alias("unknown"))


@query("SELECT dataset, CAST(sum(a) AS BIGINT) size_a, CAST(sum(b) AS BIGINT) size_b, CAST(sum(a*b) AS BIGINT) shared, CAST(sum(greatest(a,b)) AS BIGINT) together, round(CASE WHEN sum(a)>0 THEN sum(a*b)/sum(a) ELSE 0 END,9) of_a, round(CASE WHEN sum(b)>0 THEN sum(a*b)/sum(b) ELSE 0 END,9) of_b, round(CASE WHEN sum(greatest(a,b))>0 THEN sum(a*b)/sum(greatest(a,b)) ELSE 0 END,9) jaccard FROM (SELECT dataset, cell_id, max(CAST(coalesce(baran_correct,0)=1 AS INT)) a, max(CAST(coalesce(llm_correct,0)=1 AS INT)) b FROM evidence_cells GROUP BY ALL) GROUP BY dataset")
def set_overlap_jaccard(spark, d):
    return audit.set_overlap(table(spark, d, "evidence_cells"), ["dataset"], F.coalesce(F.col("baran_correct") == 1, F.lit(False)), F.coalesce(F.col("llm_correct") == 1, F.lit(False)), "cell_id")


@query("SELECT suite, round(sum(p*tp/seen)/sum(p),9) average_precision, round(sum(se)/sum(n),9) brier, CAST(sum(n) AS BIGINT) n FROM (SELECT suite, p, n, se, sum(p) OVER (PARTITION BY suite ORDER BY sc DESC) tp, sum(n) OVER (PARTITION BY suite ORDER BY sc DESC) seen FROM (SELECT suite, sc, sum(y) p, count(*) n, sum((sc-y)*(sc-y)) se FROM (SELECT suite, coalesce(llm_observed_total_tokens,0)%100/100.0::DOUBLE sc, CAST(coalesce(llm_correct,0)=1 AS INT) y FROM evidence_cells) GROUP BY ALL)) GROUP BY suite")
def routeability(spark, d):
    e = table(spark, d, "evidence_cells").select("suite", (F.coalesce("llm_observed_total_tokens", F.lit(0)) % 100 / 100.0).alias("score"), F.coalesce(F.col("llm_correct") == 1, F.lit(False)).cast("int").alias("label"))
    x = metrics.average_precision(e, ["suite"], "score", "label")
    return x.select("suite", F.round("average_precision", 9).alias("average_precision"), F.round("brier", 9).alias("brier"), "n")


@query("SELECT cell_id, dataset, CAST(llm_status='completed' AND coalesce(llm_correct,0)=1 AND coalesce(baran_correct,0)<>1 AS INT) helpful, CAST(llm_status='completed' AND coalesce(baran_correct,0)=1 AND coalesce(llm_correct,0)<>1 AS INT) harmful FROM (SELECT cell_id, dataset, coalesce(llm_status,'') llm_status, llm_correct, baran_correct FROM evidence_cells)")
def uplift_targets(spark, d):
    e = table(spark, d, "evidence_cells").select("cell_id", "dataset", "baran_correct", "llm_correct", F.coalesce(F.col("llm_status") == "completed", F.lit(False)).alias("x"))
    return gate.uplift_targets(e, "baran_correct", "llm_correct", "x").select("cell_id", "dataset", "helpful", "harmful")


# ---- grouping, samples, selection

@query("""WITH o AS (SELECT component_id, rule_id, list_sort(list_distinct(row_indices)) a FROM fd_components WHERE row_indices IS NOT NULL), w AS (SELECT component_id, rule_id, a, unnest(list_distinct(list_concat(range(0, len(a)-3, 2), [len(a)-4]))) st FROM o WHERE len(a) >= 4)
SELECT component_id, rule_id, st + 1 start_at, array_to_string(a[CAST(st+1 AS BIGINT):CAST(st+4 AS BIGINT)], ',') members, count(*) n FROM w GROUP BY ALL""")
def half_stride_windows(spark, d):
    o = table(spark, d, "fd_components").where("row_indices is not null").select("component_id", "rule_id", F.array_sort(F.array_distinct("row_indices")).alias("a"))
    w = o.select("component_id", "rule_id", "a", F.explode(grouping.exact_windows(F.col("a").cast("array<string>"), 4)).alias("m"))
    at = F.array_position(F.col("a").cast("array<string>"), F.col("m")[0])
    return w.select("component_id", "rule_id", at.cast("long").alias("start_at"), F.array_join("m", ",").alias("members")).groupBy("component_id", "rule_id", "start_at", "members").agg(F.count("*").alias("n"))


@query("SELECT cell_id, sample_id, (k-1)//4 block FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(dataset)), column_name ORDER BY row_idx, sample_id) k, count(*) OVER (PARTITION BY lower(trim(dataset)), column_name) n FROM sample_records) WHERE k <= n//4*4 AND n//4 >= 3")
def exact_blocks(spark, d):
    t = table(spark, d, "sample_records").withColumn("ds", F.lower(F.trim("dataset")))
    return grouping.exact_blocks(spark, t, ["ds", "column_name"], ["row_idx", "sample_id"], 4).select("cell_id", "sample_id", "block")


@query("SELECT sample_id, CAST(least(3, floor((k-1)*4.0/n)) AS INT) quartile FROM (SELECT sample_id, row_number() OVER (PARTITION BY column_name ORDER BY sample_rank, sample_id) k, count(*) OVER (PARTITION BY column_name) n FROM sample_records)")
def cohesion_quartile(spark, d):
    t = table(spark, d, "sample_records").select("sample_id", "column_name", "sample_rank")
    return grouping.quartiles(spark, t, ["column_name"], ["sample_rank", "sample_id"]).select("sample_id", "quartile")


@query("WITH r AS (SELECT sample_id, column_name, suite, sha256('42|'||lower(trim(dataset))||'|'||cell_id||'|'||sample_id) h FROM sample_records), t AS (SELECT *, row_number() OVER (PARTITION BY column_name, suite ORDER BY h) turn FROM r) SELECT sample_id, column_name, suite, CAST(turn AS INT) turn FROM t ORDER BY turn, column_name, suite LIMIT 300")
def stratified_round_robin(spark, d):
    """A sample of 300, the size being the operator's parameter."""
    h = F.sha2(F.concat_ws("|", F.lit("42"), F.lower(F.trim("dataset")), "cell_id", F.col("sample_id").cast("string")), 256)
    return grouping.round_robin_sample(table(spark, d, "sample_records").select("sample_id", "column_name", "suite", "dataset", "cell_id"), ["column_name", "suite"], h, 300).select("sample_id", "column_name", "suite", "turn")


@query("""WITH c AS (SELECT lower(trim(dataset)) dataset, column_name, count(*) "count" FROM sample_records GROUP BY ALL), s AS (SELECT *, floor(sum("count") OVER (PARTITION BY dataset)*0.3) n, sum("count") OVER (PARTITION BY dataset) t FROM c),
x AS (SELECT *, floor(round(n*"count"/t,9)) fl, round(n*"count"/t - floor(round(n*"count"/t,9)),9) fr FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY fr DESC, sha256('42|quota|'||column_name)) k, n - sum(fl) OVER (PARTITION BY dataset) rest FROM x)
SELECT dataset, column_name, "count", CAST(least("count", fl + CAST(k<=rest AS INT)) AS BIGINT) quota FROM r""")
def hamilton_quota(spark, d):
    t = table(spark, d, "sample_records").withColumn("dataset", F.lower(F.trim("dataset")))
    return grouping.hamilton_quotas(t, ["dataset"], "column_name", 0.3, 42)


@query("SELECT sample_id, CAST(row_number() OVER (PARTITION BY lower(trim(dataset)), column_name ORDER BY sha256('42|'||cell_id), cell_id, sample_id) AS INT) sample_rank FROM sample_records")
def hash_ranked_cells(spark, d):
    t = table(spark, d, "sample_records").select("sample_id", F.lower(F.trim("dataset")).alias("dataset"), "column_name", "cell_id")
    return grouping.hash_ranked(spark, t, ["dataset", "column_name"], "cell_id", 42, ["sample_id"]).select("sample_id", "sample_rank")


@query(_with(O.BASE, "SELECT dataset, query_id, count(*) cells, CAST(max(query_cost) AS BIGINT) query_cost, round(1 - max(query_cost)/(count(*)*202.0), 9) saving_ratio FROM responses WHERE s=2 GROUP BY ALL"))
def saving_ratio(spark, d):
    r = O.responses(spark, d).where("s = 2")
    return r.groupBy("dataset", "query_id").agg(F.count("*").alias("cells"), F.max("query_cost").alias("query_cost"), F.round(1 - F.max("query_cost") / (F.count("*") * 202.0), 9).alias("saving_ratio"))


@query(_with(O.BASE, "SELECT dataset, CAST(sum(b) AS BIGINT) objective_units, count(*) covered_cells FROM (SELECT dataset, cell_id, greatest(0, max(CAST(round(uplift*1000) AS BIGINT))) b FROM responses WHERE candidate IS NOT NULL GROUP BY ALL) GROUP BY dataset"))
def objective_value(spark, d):
    r = O.responses(spark, d).where("candidate is not null").withColumn("gain_units", F.round(F.col("uplift") * 1000).cast("long"))
    return selection.objective_value(r, ["dataset"])


@query()
def mgreedy_select(spark, d):
    """Greedy choice per data set under a fifth of what asking every cell alone would cost; tested against exhaustive search."""
    r = O.responses(spark, d).where("candidate is not null").withColumn("gain_units", S.exact_units(F.col("uplift")))
    ref = r.where("s = 1").groupBy("dataset").agg(F.bround(F.sum("query_cost") * 0.2).cast("long").alias("budget"))
    return selection.select_queries(r.join(ref, "dataset"), ["dataset"])


@query()
def leaf_order(spark, d):
    """Leaf order of the embeddings of each label; tested against a plain rendering of the contract."""
    return grouping.leaf_orders(table(spark, d, "embeddings").select("label", F.col("vec_id").cast("string").alias("key"), "embedding"), ["label"], "key", "embedding")


@query()
def bootstrap_ci(spark, d):
    """Interval of the net gain per data set under resampling of rows of cells; tested against plain loops with the same draws."""
    e = table(spark, d, "evidence_cells").withColumn("net", F.coalesce("llm_correct", F.lit(0)) - F.coalesce("baran_correct", F.lit(0)))
    return statistics.bootstrap_means(e, ["suite", "dataset"], "row_cluster", "net")


@query("SELECT h.head_id, count(DISTINCT e.dataset) train_datasets, count(e.dataset) train_rows FROM fitted_heads h LEFT JOIN (SELECT dataset, base_family, count(*) c FROM evidence_cells WHERE base_family IS NOT NULL GROUP BY ALL) e ON e.base_family <> h.family_left_out GROUP BY 1")
def family_holdout(spark, d):
    """Per head: data sets and (data set, family) statements left for training without its family."""
    e = table(spark, d, "evidence_cells").where("base_family is not null").groupBy("dataset", "base_family").agg(F.count("*").alias("c"))
    per = e.groupBy("base_family").agg(F.count("*").alias("own_rows"))
    sets = e.groupBy("dataset").agg(F.count("*").alias("families"))
    total = e.agg(F.count("*").alias("all_rows"), F.countDistinct("dataset").alias("all_sets"))
    lost = e.join(sets.where("families = 1"), "dataset").groupBy("base_family").agg(F.count("*").alias("lost"))
    h = table(spark, d, "fitted_heads").select("head_id", F.col("family_left_out").alias("base_family"))
    x = h.join(per, "base_family", "left").join(lost, "base_family", "left").join(F.broadcast(total))  # one row
    none = F.col("base_family").isNull()
    return x.select("head_id", F.when(none, 0).otherwise(F.col("all_sets") - F.coalesce("lost", F.lit(0))).cast("long").alias("train_datasets"), F.when(none, 0).otherwise(F.col("all_rows") - F.coalesce("own_rows", F.lit(0))).cast("long").alias("train_rows"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN weekday_ < 5 AND (h BETWEEN 1 AND 3 OR h BETWEEN 6 AND 9) THEN 'peak' ELSE 'off_peak' END period, count(*) n FROM (SELECT l_orderkey, l_linenumber, isodow(l_shipdate)-1 weekday_, hour(l_shipdate) h FROM lineitem) GROUP BY ALL")
def price_period(spark, d):
    t = table(spark, d, "lineitem")
    period = S.price_period(F.col("l_shipdate"))
    return t.groupBy("l_orderkey", "l_linenumber", period.alias("period")).agg(F.count("*").alias("n"))


@query(_with(O.CANDIDATES, """, changed AS (SELECT DISTINCT dataset, cell_id FROM decided WHERE reason='accepted'), causes AS (SELECT DISTINCT query_id FROM responses WHERE h < 3), sel AS (SELECT DISTINCT dataset, query_id FROM responses WHERE s=2)
SELECT dataset, cell_id FROM changed c WHERE NOT EXISTS (SELECT 1 FROM responses r JOIN causes USING (query_id) JOIN sel ON sel.query_id=r.query_id WHERE r.cell_id=c.cell_id AND sel.dataset=c.dataset)"""))
def causal_scope(spark, d):
    r = O.responses(spark, d)
    changed = verify.decide(O.candidates(spark, d)).where("accepted").select("dataset", "cell_id").distinct()
    return audit.unexplained_changes(changed, r.where("h < 3").select("query_id"), r.select("query_id", "cell_id"), r.where("s = 2").select("dataset", "query_id"), ["dataset"])


@query(_with(O.BASE, "SELECT cell_id, s, CASE WHEN status<>'success' OR candidate IS NULL THEN base_value ELSE candidate END prediction, CASE WHEN status<>'success' OR candidate IS NULL THEN 'base' ELSE 'llm' END final_source FROM responses JOIN base_values USING (dataset, col_idx)"))
def fallback_rows(spark, d):
    r = O.responses(spark, d).join(O.base_values(spark, d), ["dataset", "col_idx"])
    lacks = (F.col("status") != "success") | F.col("candidate").isNull()
    return r.select("cell_id", "s", F.when(lacks, F.col("base_value")).otherwise(F.col("candidate")).alias("prediction"), F.when(lacks, "base").otherwise("llm").alias("final_source"))


@query(_with(O.BASE, "SELECT dataset, count(*) n, round(avg(CAST(a.candidate IS NOT DISTINCT FROM a.clean_value AS INT)),9) singleton_accuracy, round(avg(CAST(b.candidate IS NOT DISTINCT FROM b.clean_value AS INT)),9) group_accuracy, CAST(sum(CAST(b.candidate IS NOT DISTINCT FROM b.clean_value AND a.candidate IS DISTINCT FROM a.clean_value AS INT)) AS BIGINT) rescued, CAST(sum(CAST(a.candidate IS NOT DISTINCT FROM a.clean_value AND b.candidate IS DISTINCT FROM b.clean_value AS INT)) AS BIGINT) interfered FROM responses a JOIN responses b USING (dataset, cell_id) WHERE a.s=1 AND b.s=2 GROUP BY dataset"))
def batch_interference(spark, d):
    ok = F.coalesce(F.col("candidate") == F.col("clean_value"), F.lit(False))
    r = O.responses(spark, d).groupBy("dataset", "cell_id").agg(F.max((F.col("s") == 1) & ok).alias("a"), F.max((F.col("s") == 2) & ok).alias("b"))
    i = lambda c: c.cast("int")
    return r.groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.avg(i(F.col("a"))), 9).alias("singleton_accuracy"), F.round(F.avg(i(F.col("b"))), 9).alias("group_accuracy"), F.sum(i(F.col("b") & ~F.col("a"))).alias("rescued"), F.sum(i(F.col("a") & ~F.col("b"))).alias("interfered"))


@query("SELECT CASE WHEN g=1 THEN 'ALL' ELSE backend END backend, n, distinct_cells, invalid FROM (SELECT backend, grouping(backend) g, count(*) n, count(DISTINCT cell_id) distinct_cells, count(*) FILTER (coalesce(parse_status,'') NOT LIKE 'ok%') invalid FROM final_records GROUP BY ROLLUP(backend))")
def selection_audit(spark, d):
    x = table(spark, d, "final_records").rollup("backend").agg(F.grouping("backend").alias("g"), F.count("*").alias("n"), F.countDistinct("cell_id").alias("distinct_cells"), F.sum((~F.coalesce("parse_status", F.lit("")).startswith("ok")).cast("int")).alias("invalid"))
    return x.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("backend")).alias("backend"), "n", "distinct_cells", "invalid")


@query()
def content_digest(spark, d):
    """A digest of the ledger's content that doesn't depend on row order; tested on shuffled copies."""
    t = table(spark, d, "final_records")
    return audit.content_digest(t, [F.col(c) for c in sorted(t.columns)])
