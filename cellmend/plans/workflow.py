"""Queries on how group queries are made, costed, asked and merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.functions import scalars as S
from cellmend.operators import audit, cells, gate, grouping, ledger, metrics, prompts, rules, workflow
from cellmend.plans import overlays as O
from cellmend.session import Stages
from cellmend.operators.deliveries import canonical_digest
from cellmend.plans.registry import register
from cellmend.sources.tables import table
from cellmend.streaming import ledger as stream_ledger

QUERIES, SQL, query = register()


_ACTIONS = O.BASE + """
, o AS (SELECT dataset, row_idx, list(cell_id ORDER BY col_idx) a FROM found GROUP BY ALL HAVING count(*) > 1),
w AS (SELECT dataset, a, unnest(list_distinct(list_concat(range(0, len(a)-1, 1), [len(a)-2]))) st FROM o),
acts AS (SELECT 'row' AS "view", dataset, list_sort(a[CAST(st+1 AS BIGINT):CAST(st+2 AS BIGINT)]) ids FROM w UNION ALL SELECT 'singleton', dataset, [cell_id] FROM found),
actions AS (SELECT *, len(ids) size, left(sha256('{"cell_ids":["'||array_to_string(ids,'","')||'"],"dataset":"'||dataset||'"}'), 24) query_id FROM acts)
"""


def _actions(spark, d):
    found = O.found(spark, d)
    return workflow.group_actions(found, [("row", workflow.row_orders(found))], [2])


@query(f'WITH {_ACTIONS} SELECT query_id, "view", dataset, array_to_string(ids, \',\') members, CAST(size AS INT) size FROM actions')
def row_actions(spark, d):
    return _actions(spark, d).select("query_id", "view", "dataset", F.array_join("cell_ids", ",").alias("members"), "size")


@query(f"""WITH {_ACTIONS}, m AS (SELECT *, unnest(range(0, size)) i FROM actions) SELECT query_id, m.ids[CAST(i+1 AS BIGINT)] cell_id, CAST(i AS INT) member_index, round(i/greatest(1, size-1), 9) AS position, CAST(CASE WHEN size=1 THEN 202 ELSE 64+202*size END AS BIGINT) query_cost, round(1-(CASE WHEN size=1 THEN 202 ELSE 64+202*size END)/(202.0*size), 9) saving_ratio FROM m""")
def pair_features(spark, d):
    return workflow.pair_features(_actions(spark, d), O.found(spark, d)).select("query_id", "cell_id", "member_index", "position", "query_cost", "saving_ratio")


@query(f'WITH {_ACTIONS} SELECT "view", CAST(size AS INT) size, count(*) queries, CAST(sum(size) AS BIGINT) memberships FROM actions GROUP BY ALL')
def generation_audit(spark, d):
    return _actions(spark, d).groupBy("view", "size").agg(F.count("*").alias("queries"), F.sum("size").cast("long").alias("memberships"))


def _view_actions(spark, d):
    """(actions, found cells, masked rows): every cell of both tables alone and in windows of 2, 4 and 8 of every view.

    Rows and the groups of the public rule (brand gives ptype; customer has no rule) are ordered by
    pattern and semantic vectors together, columns by either.
    """
    stages = Stages(spark, "views")
    cell, place = "cell_id", ["dataset", "column_name"]
    both = stages.keep(O.pairs(spark, d).drop(cell))  # tables meet once
    n = both.where("dirty_value = clean_value").groupBy("dataset", "col_idx", F.col("dirty_value").alias("base_value")).agg(F.count("*").alias("_n"))
    base = n.groupBy("dataset", "col_idx").agg(F.min_by(F.struct("base_value", "_n"), F.struct(-F.col("_n"), "base_value")).alias("_b"), F.sum("_n").alias("_all"))  # a column is one row
    base = base.select("dataset", "col_idx", "_b.base_value", (F.col("_b._n") / F.col("_all")).alias("base_share"))
    errors = cells.errors(both).withColumn(cell, S.cell_id(F.col("suite"), F.col("dataset"), F.col("row_idx"), F.col("col_idx")))
    found = stages.keep(errors.join(F.broadcast(base), ["dataset", "col_idx"], "left").fillna({"base_value": "", "base_share": 0.0}))
    tables = [("part", O.dirty_part(spark, d), O.PART), ("customer", O.dirty_customer(spark, d), O.CUSTOMER)]
    rows = None
    for name, dirty, columns in tables:
        masked = cells.masked_rows(dirty, found.where(F.col("dataset") == name), "row_idx", columns)
        rows = masked if rows is None else rows.unionByName(masked)
    formed = stages.keep(workflow.cell_forms(workflow.signatures(found), rows))
    forms = stages.keep(workflow.forms_of(formed))
    pattern = stages.keep(workflow.packed(workflow.pattern_vectors(forms.dropDuplicates(["pattern"])), "pattern"))
    semantic = stages.keep(workflow.semantic_vectors(forms))
    merged = workflow.merged_packed(forms.select("form", "pattern").join(pattern, "pattern").drop("pattern"), semantic, "form", (0.65, 0.35))
    shared = found.groupBy("dataset", "row_idx").agg(F.count("*").alias("_k")).where("_k > 1").select("dataset", "row_idx")
    broken = rules.violation_members(O.dirty_part(spark, d), found.where("dataset = 'part'"), "row_idx", ["brand"], "ptype", O.PART, "source", "part", "part_fd1")
    in_rule = broken.select(F.lit("part").alias("dataset"), "component_id", cell).join(formed.select(cell, "form"), cell)
    views = [
        ("semantic", formed, place, "form", semantic),
        ("public_fd", in_rule, ["dataset", "component_id"], "form", merged),
        ("row", formed.join(shared, ["dataset", "row_idx"]), ["dataset", "row_idx"], "form", merged),
        ("pattern", formed, place, "pattern", pattern),
    ]
    # orders of all views in one run, those of the largest buckets first, so that these don't wait for one another
    of = [workflow.form_orders(items, bucket, cell, form, vectors).select(F.lit(view).alias("view"), "dataset", "ordered") for view, items, bucket, form, vectors in views]
    orders = stages.keep(reduce(DataFrame.unionByName, of), ["view"])
    return workflow.group_actions(found, [(view[0], orders.where(F.col("view") == view[0]).drop("view")) for view in views], [2, 4, 8]), found, formed.select(cell, "masked")


@query()
def pattern_view_actions(spark, d):
    """Windows over the leaf orders of all views of all error cells of both tables; tested for coverage and against the leaf-order contract."""
    return _view_actions(spark, d)[0].select("query_id", "view", "dataset", "size")


@query()
def prompt_requests(spark, d):
    """Prompts of all single cells and groups of both tables with their ids and costs; tested for stability and leaks."""
    actions, found, rows = _view_actions(spark, d)
    # a prompt holds the id of its query, so no two have one prompt
    x = prompts.with_prompts(actions.select("query_id", "dataset", "cell_ids"), found, rows).withColumn("leaks", prompts.leaks(F.col("payload")))
    hashed = prompts.request_hash(F.lit("gen-small"), F.col("prompt_hash"), F.col("completion_ceiling"))
    return x.select("query_id", "prompt_hash", hashed.alias("request_hash"), "prompt_tokens", "completion_ceiling", "leaks")


@query("SELECT delivery_id, regexp_matches(lower(response_text), '\"(" + "|".join(prompts.FORBIDDEN_KEYS) + ")\"\\s*:') leaks FROM group_checkpoint")
def forbidden_keys(spark, d):
    return table(spark, d, "group_checkpoint").select("delivery_id", prompts.leaks(F.col("response_text")).alias("leaks"))


_PHASES = sorted({*workflow.REUSABLE, *(x for v in workflow.REUSABLE.values() for x in v)})


@query("WITH p AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in _PHASES) + "]) phase UNION SELECT phase FROM group_checkpoint WHERE phase IS NOT NULL) SELECT t.phase target, s.phase source, t.phase = s.phase OR " + " OR ".join(f"(t.phase='{t}' AND s.phase IN ({', '.join(repr(x) for x in v)}))" for t, v in workflow.REUSABLE.items()) + " compatible FROM p t, p s")
def phase_compatible(spark, d):
    """All pairs of the phases there are, a handful by design."""
    own = table(spark, d, "group_checkpoint").where("phase is not null").select("phase").distinct()
    names = sorted({*_PHASES, *(r[0] for r in own.collect())})
    pairs = spark.createDataFrame([(t, s) for t in names for s in names], "target string, source string")
    return pairs.withColumn("compatible", workflow.compatible_phase(F.col("target"), F.col("source")))


@query("SELECT doc_id, regexp_matches(coalesce(text,''), '(?i)" + "|".join(prompts.FORBIDDEN_TEXT) + "') leaks FROM documents")
def forbidden_text(spark, d):
    return table(spark, d, "documents").select("doc_id", prompts.text_leaks(F.coalesce("text", F.lit(""))).alias("leaks"))


_SEG = "CASE WHEN hour(received_at) < 12 THEN 0 ELSE 1 END"


@query(f"SELECT q, delivery_id, status, CASE WHEN seg=0 THEN 'early' ELSE 'late' END AS role, seg=1 fresh FROM (SELECT @query_id q, *, {_SEG} seg, row_number() OVER (PARTITION BY @query_id ORDER BY {_SEG} DESC, delivery_id DESC) k FROM group_checkpoint WHERE query_id IS NOT NULL) WHERE k=1")
def merged_ledger(spark, d):
    t = table(spark, d, "group_checkpoint").where("query_id is not null").select(canonical_digest(F.col("query_id")).alias("q"), "delivery_id", "status", "received_at", F.col("delivery_id").alias("row_index"))
    early = F.coalesce(F.hour("received_at") < 12, F.lit(False))
    return workflow.merged_ledger([("early", t.where(early)), ("late", t.where(~early))], ["q"]).select("q", "delivery_id", "status", "role", "fresh")


@query("WITH r AS (SELECT @query_id q, max(greatest(1,length(coalesce(response_text,'')))) planned_tokens FROM group_checkpoint WHERE query_id IS NOT NULL GROUP BY 1) SELECT q, CAST(planned_tokens AS BIGINT) planned_tokens, CAST(planned_tokens*6+1024 AS BIGINT) worst_case_tokens FROM r WHERE q NOT IN (SELECT @query_id FROM group_checkpoint WHERE status='success' AND query_id IS NOT NULL)")
def retry_plan(spark, d):
    t = table(spark, d, "group_checkpoint").where("query_id is not null").withColumn("q", canonical_digest(F.col("query_id")))
    r = t.groupBy("q").agg(F.max(F.greatest(F.lit(1), F.length(F.coalesce("response_text", F.lit(""))))).cast("long").alias("planned_tokens"))
    return workflow.retry_plan(r, t, ["q"])


@query("SELECT base_family, round(sum(coalesce(llm_observed_total_tokens,0) * CASE WHEN coalesce(llm_observed_total_tokens,0) <= 1000 THEN 0.022 WHEN coalesce(llm_observed_total_tokens,0) <= 3000 THEN 0.66 ELSE 1.98 END::DOUBLE)/1e6, 6) cost FROM evidence_cells GROUP BY ALL")
def price_tiers(spark, d):
    tokens = F.coalesce("llm_observed_total_tokens", F.lit(0))
    return table(spark, d, "evidence_cells").groupBy("base_family").agg(F.round(F.sum(tokens * prompts.price(tokens, [(1000, 0.022), (3000, 0.66), (None, 1.98)])) / 1e6, 6).alias("cost"))


@query("SELECT phase, round(avg(n),9) mean_size, round(median(n),9) median_size, max(n) max_size FROM (SELECT phase, CAST(len(cell_ids) AS INT) n FROM group_checkpoint WHERE cell_ids IS NOT NULL) GROUP BY ALL")
def group_size_metrics(spark, d):
    t = table(spark, d, "group_checkpoint").where("cell_ids is not null").select("phase", F.size("cell_ids").alias("n"))
    return t.groupBy("phase").agg(F.round(F.avg("n"), 9).alias("mean_size"), F.round(F.percentile("n", 0.5), 9).alias("median_size"), F.max("n").alias("max_size"))


@query("SELECT phase, count(*) physical, CAST(sum(attempts) AS BIGINT) attempts, CAST(sum(cells) AS BIGINT) logical_cells FROM (SELECT phase, q, arg_min(attempts, delivery_id) attempts, arg_min(coalesce(len(cell_ids),0), delivery_id) cells FROM (SELECT *, @query_id q FROM group_checkpoint WHERE query_id IS NOT NULL) GROUP BY ALL) GROUP BY ALL")
def arm_costs(spark, d):
    t = table(spark, d, "group_checkpoint").where("query_id is not null").withColumn("q", canonical_digest(F.col("query_id")))
    return metrics.arm_costs(t, ["phase"], "q", "delivery_id", "attempts", "cell_ids")


@query("SELECT q, ok, failed, contents, CASE WHEN contents>1 THEN 'conflict' WHEN ok>0 AND failed>0 THEN 'recovered' WHEN ok>0 THEN 'success' ELSE 'failed' END state FROM (SELECT @query_id q, count(*) FILTER (status='success') ok, count(*) FILTER (status IS DISTINCT FROM 'success') failed, count(DISTINCT CASE WHEN status='success' THEN sha256(response_text) END) contents FROM group_checkpoint WHERE query_id IS NOT NULL GROUP BY 1)")
def cache_union_audit(spark, d):
    t = table(spark, d, "group_checkpoint").where("query_id is not null").withColumn("q", canonical_digest(F.col("query_id")))
    return ledger.cache_union(t, ["q"], "response_text")


@query("WITH f AS (SELECT dataset, avg(coalesce(llm_correct,0)) - avg(coalesce(baran_correct,0)) net FROM evidence_cells GROUP BY ALL), r AS (SELECT dataset, base_family, avg(coalesce(llm_correct,0)) - avg(coalesce(baran_correct,0)) net FROM evidence_cells GROUP BY ALL), s AS (SELECT dataset, coalesce(stddev_samp(net), 0) sigma FROM r GROUP BY ALL) SELECT dataset, round(net,9) net_gain, round(sigma,9) sigma, round(greatest(0, net-sigma),9) conservative_uplift FROM f JOIN s USING (dataset)")
def sigma_ell(spark, d):
    e = table(spark, d, "evidence_cells").select("dataset", F.coalesce("base_family", F.lit("\0")).alias("base_family"), F.coalesce("llm_correct", F.lit(0)).alias("l"), F.coalesce("baran_correct", F.lit(0)).alias("b"))
    means = [F.avg("l").alias("p_helpful"), F.avg("b").alias("p_harmful")]
    p = e.groupBy("dataset").agg(*means).withColumn("replica", F.lit("full")).unionByName(e.groupBy("dataset", F.concat(F.lit("f:"), "base_family").alias("replica")).agg(*means))
    return gate.gain_and_spread(p, ["dataset"]).select("dataset", *(F.round(c, 9).alias(c) for c in ("net_gain", "sigma", "conservative_uplift")))


# fixed values: words that name no family
NO_FAMILY = ["", "unknown", "n/a"]


@query()
def uplift_gate(spark, d):
    """Two linear heads with one replica per base family left out; held-out behaviour is tested."""
    e = table(spark, d, "evidence_cells").withColumns({"executable": F.coalesce(F.col("llm_status") == "completed", F.lit(False))})
    e = gate.uplift_targets(e, "baran_correct", "llm_correct", "executable").withColumns({"value_type": S.value_type(F.coalesce("dirty_value", F.lit(""))), "length": F.length(F.coalesce("dirty_value", F.lit(""))), "tokens": F.col("llm_observed_total_tokens")})
    name = F.lower(F.regexp_replace("base_family", r"^\s+|\s+$", ""))
    e = e.select(F.when(~name.isin(*NO_FAMILY), name).alias("family"), "cell_id", "column_name", "value_type", "length", "tokens", "helpful", "harmful")
    p = gate.UpliftGate(["length", "tokens"], ["value_type", "column_name"], "family", linear=True).predict(e, e.select("cell_id", "value_type", "column_name", "length", "tokens"))
    return gate.gain_and_spread(p, ["cell_id"])


@query("SELECT label, g, count(*) pairs, round(avg(list_dot_product(x,y)/sqrt(list_dot_product(x,x))/sqrt(list_dot_product(y,y))), 6) cohesion FROM (SELECT a.label, a.vec_id//8 g, a.embedding::DOUBLE[] x, b.embedding::DOUBLE[] y FROM embeddings a JOIN embeddings b ON a.label=b.label AND a.vec_id//8=b.vec_id//8 AND a.vec_id<b.vec_id) GROUP BY ALL")
def group_cohesion(spark, d):
    """Mean cosine over the pairs of a group's members, eight at most."""
    e = table(spark, d, "embeddings").select("label", F.expr("vec_id div 8").alias("g"), "vec_id", "embedding")
    other = e.select("label", "g", F.col("vec_id").alias("v2"), F.col("embedding").alias("e2"))
    x = e.join(other, ["label", "g"]).where("vec_id < v2")
    return x.groupBy("label", "g").agg(F.count("*").alias("pairs"), F.round(F.avg(grouping.cosine(F.col("embedding"), F.col("e2"))), 6).alias("cohesion"))


@query("""WITH g AS (SELECT s_suppkey, substr(lower(s_name), CAST(i AS BIGINT), CAST(n AS BIGINT)) term FROM supplier, (VALUES (2),(3)) v(n), LATERAL (SELECT unnest(range(1, length(s_name)-n+2)) i)), t AS (SELECT s_suppkey, term, count(*) tf FROM g GROUP BY ALL), f AS (SELECT term, count(*) df FROM t GROUP BY 1),
w AS (SELECT s_suppkey, term, (1+ln(tf))*(ln((1.0+(SELECT count(*) FROM supplier))/(1+df))+1) w FROM t JOIN f USING (term)) SELECT s_suppkey, term, round(w/sqrt(sum(w*w) OVER (PARTITION BY s_suppkey)), 6) weight FROM w""")
def tfidf_terms(spark, d):
    return grouping.tfidf(table(spark, d, "supplier"), "s_suppkey", "s_name", 2, 3).withColumn("weight", F.round("weight", 6))


@query()
def schedule(spark, d):
    """Conditions take turns, numbered densely; tested against a plain deque."""
    q = table(spark, d, "sample_records").select(F.col("column_name").alias("condition"), "sample_id")
    return workflow.schedule_index(spark, grouping.round_robin_schedule(spark, q, "condition", "sample_id", 42)).select("sample_id", "condition", "turn", "logical_index")


@query()
def random_partition(spark, d):
    """Blocks of four with the members of every place moved to other blocks; tested for staying nowhere."""
    t = table(spark, d, "sample_records").withColumn("ds", F.lower(F.trim("dataset")))
    b = grouping.exact_blocks(spark, t, ["ds", "column_name"], ["row_idx", "sample_id"], 4)
    b = grouping.ranks(spark, b, ["ds", "column_name", "block"], ["row_idx", "sample_id"]).withColumn("member_index", (F.col("rank") - 1).cast("int"))
    return workflow.random_partner(b.select("ds", "column_name", "block", "member_index", "sample_id"), ["ds", "column_name"], 42)


@query("SELECT @query_id q, coalesce(@prompt_hash, '') p, min(delivery_id) delivery_id FROM group_checkpoint WHERE query_id IS NOT NULL GROUP BY ALL")
def streamed_ledger(spark, d):
    """The checkpoint's answers arriving as a stream of files, each query and prompt taken once."""
    base = Stages(spark, "stream").base
    t = table(spark, d, "group_checkpoint").where("query_id is not null").select(canonical_digest(F.col("query_id")).alias("q"), F.coalesce(canonical_digest(F.col("prompt_hash")), F.lit("")).alias("p"), "delivery_id")
    # files in the order of their deliveries, as they would arrive
    t.repartitionByRange("delivery_id").sortWithinPartitions("delivery_id").write.parquet(f"{base}/in")
    stream_ledger.ingest(spark, f"{base}/in", t.schema, f"{base}/ledger", f"{base}/state", ["q", "p"], "delivery_id").awaitTermination()
    return spark.read.parquet(f"{base}/ledger").select("q", "p", "delivery_id")


@query("WITH a AS (SELECT cell_id, arg_max({'p': prediction, 's': parse_status}, row_index) r FROM final_records WHERE method_name='base_repair' GROUP BY 1), b AS (SELECT cell_id, arg_max({'p': prediction, 's': parse_status}, row_index) r FROM final_records WHERE method_name='llm_only' GROUP BY 1) SELECT cell_id, 'prediction' field, a.r.p AS \"before\", b.r.p AS \"after\" FROM a JOIN b USING (cell_id) WHERE a.r.p IS DISTINCT FROM b.r.p UNION ALL SELECT cell_id, 'parse_status', a.r.s, b.r.s FROM a JOIN b USING (cell_id) WHERE a.r.s IS DISTINCT FROM b.r.s")
def field_differences(spark, d):
    side = lambda m: ledger.latest(table(spark, d, "final_records").where(F.col("method_name") == m).select("cell_id", "row_index", "prediction", "parse_status"), ["cell_id"], ["row_index"])
    return audit.field_differences(side("base_repair"), side("llm_only"), ["cell_id"], ["prediction", "parse_status"])


@query("SELECT suite, column_name, count(DISTINCT baran_prediction) base_values, round(avg(coalesce(llm_correct,0)),9) llm_mean, count(DISTINCT row_cluster) clusters FROM evidence_cells GROUP BY GROUPING SETS ((suite, column_name)) ")
def paired_clusters(spark, d):
    return table(spark, d, "evidence_cells").groupBy("suite", "column_name").agg(F.countDistinct("baran_prediction").alias("base_values"), F.round(F.avg(F.coalesce("llm_correct", F.lit(0))), 9).alias("llm_mean"), F.countDistinct("row_cluster").alias("clusters"))


