"""Queries on quality of the three arms, complementarity in full, and paired resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.functions import scalars as S
from cellmend.operators import audit, candidates, gate, groups, metrics, statistics
from cellmend.plans import overlays as O
from cellmend.plans import repair as R
from cellmend.plans import workflow as W
from cellmend.plans.registry import register
from cellmend.sources.tables import table

QUERIES, SQL, query = register()


def group_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every error cell in one condition (view, size), with an answer of each arm by whole-number formulas that meet every state."""
    r, c = F.col("row_idx"), F.col("col_idx")
    x = O.found(spark, d).withColumns({"source_view": F.when(r % 2 == 0, "pattern").otherwise("semantic"), "group_size": F.element_at(F.array(F.lit(2), F.lit(4), F.lit(8)), (F.expr("row_idx div 40") % 3 + 1).cast("int"))})
    for k, a in enumerate(groups.ARMS, 1):
        h = (r * 31 + c * 17 + k * 7) % 20
        x = x.withColumns({
            f"{a}_status": F.when(h == 19, "failed").otherwise("Success"),
            f"{a}_parse_status": F.when(h == 18, "no_json_object").when(h == 13, "odd").otherwise("ok"),
            f"{a}_decision": F.when(h == 16, "abstain").when(h != 17, "propose"),
            f"{a}_prediction": F.when((h < 9) | (h == 13), F.col("clean_value")).when(h < 13, F.concat(F.lit("~"), "dirty_value")).when(h == 14, F.col("dirty_value")).when(h == 15, ""),
        })
    return x


def _arm(k: int, a: str) -> str:
    h = f"(row_idx*31+col_idx*17+{k}*7)%20"
    state = f"CASE WHEN {h}=19 THEN 'provider_failure' WHEN {h}=18 THEN 'parse_failure' WHEN {h}=17 THEN 'missing' WHEN {h}=16 THEN 'abstain' WHEN coalesce({a}_p,'')='' THEN 'empty' WHEN {a}_p=dirty_value THEN 'unchanged' WHEN {h}=13 THEN 'other_invalid' ELSE 'valid' END"
    return f"{state} {a}_state, coalesce({state}='valid' AND {a}_p=clean_value, false) {a}_correct"


_PREDICTED = ", ".join(f"CASE WHEN (row_idx*31+col_idx*17+{k}*7)%20 < 9 OR (row_idx*31+col_idx*17+{k}*7)%20=13 THEN clean_value WHEN (row_idx*31+col_idx*17+{k}*7)%20<13 THEN '~'||dirty_value WHEN (row_idx*31+col_idx*17+{k}*7)%20=14 THEN dirty_value WHEN (row_idx*31+col_idx*17+{k}*7)%20=15 THEN '' END {a}_p" for k, a in enumerate(groups.ARMS, 1))
_CELLS = O.BASE + f""", gp AS (SELECT *, CASE WHEN row_idx%2=0 THEN 'pattern' ELSE 'semantic' END source_view, CAST([2,4,8][CAST((row_idx//40)%3+1 AS BIGINT)] AS VARCHAR) group_size, {_PREDICTED} FROM found),
gc AS (SELECT *, {', '.join(_arm(k, a) for k, a in enumerate(groups.ARMS, 1))} FROM gp)"""


def _indicator(name: str) -> str:
    one = lambda b: f"CAST({b} AS INT)"
    for a in groups.ARMS:
        if name == f"{a}_accuracy":
            return one(f"{a}_correct")
        if name == f"{a}_rescue_rate":
            return one(f"{a}_correct AND NOT singleton_correct")
        if name == f"{a}_interference_rate":
            return one(f"singleton_correct AND NOT {a}_correct")
        if name == f"{a}_invalid_rate":
            return one(f"{a}_state<>'valid'")
        for s in groups.INVALID:
            if name == f"{a}_{s}_rate":
                return one(f"{a}_state='{s}'")
    a, b = name.split("_minus_")
    return f"{one(f'{a}_correct')} - {one(f'{b}_correct')}"


def _level(scope: str, suite: str, dataset: str, view: str = "source_view", size: str = "group_size") -> str:
    rates = ", ".join(f"sum({n})/sum(n) {n}" for n in groups.RATES)
    return f"SELECT '{scope}' AS scope, {suite} suite, {dataset} dataset, {view} source_view, {size} group_size, sum(n) n, sum(cells) cells, {rates} FROM per GROUP BY ALL"


def _macro(scope: str, source: str) -> str:
    return f"SELECT '{scope}', 'ALL', 'MACRO', source_view, group_size, sum(n), sum(cells), {', '.join(f'avg({n})' for n in groups.RATES)} FROM {source} GROUP BY source_view, group_size"


@query(f"""WITH {_CELLS}, per AS (SELECT suite, dataset, source_view, group_size, count(*) n, count(DISTINCT cell_id) cells, {', '.join(f'sum({_indicator(n)}) {n}' for n in groups.RATES)} FROM gc GROUP BY ALL),
own AS ({_level('dataset', 'suite', 'dataset')}), overall AS ({_level('dataset', 'suite', 'dataset', "'ALL'", "'ALL'")}),
every AS (SELECT * FROM own UNION ALL {_level('suite', 'suite', "'ALL'")} UNION ALL {_level('micro', "'ALL'", "'MICRO'")} UNION ALL {_macro('macro', 'own')} UNION ALL {_level('micro_all_conditions', "'ALL'", "'MICRO'", "'ALL'", "'ALL'")} UNION ALL {_macro('macro_all_conditions', 'overall')})
SELECT scope, suite, dataset, source_view, group_size, CAST(n AS BIGINT) n, CAST(cells AS BIGINT) cells, {', '.join(f'round({n},9) {n}' for n in groups.RATES)} FROM every""")
def group_metrics(spark, d):
    return groups.group_metrics(group_cells(spark, d)).select(*groups.PLACE, "n", "cells", *(F.round(n, 9).alias(n) for n in groups.RATES))


@query(f"WITH {_CELLS} SELECT scope, suite, dataset, source_view, group_size FROM (SELECT 'none' AS scope, * FROM gc) WHERE false")
def group_metric_identities(spark, d):
    """Rows that break an identity between the rates: none."""
    return groups.identity_violations(groups.group_metrics(group_cells(spark, d)))


_TRANSITIONS = ", ".join(f"('{a}_minus_{b}', count(*) FILTER ({a}_correct AND {b}_correct), count(*) FILTER ({a}_correct AND NOT {b}_correct), count(*) FILTER (NOT {a}_correct AND {b}_correct), count(*) FILTER (NOT {a}_correct AND NOT {b}_correct))" for a, b in groups.CONTRASTS)


def _places() -> str:
    out = []
    for scope, suite, dataset in (("dataset", "suite", "dataset"), ("suite", "suite", "'ALL'"), ("micro", "'ALL'", "'MICRO'")):
        for a, b in groups.CONTRASTS:
            p, q = f"{a}_correct", f"{b}_correct"
            out.append(f"SELECT '{scope}' AS scope, {suite} suite, {dataset} dataset, source_view, group_size, '{a}_minus_{b}' contrast, count(*) FILTER ({p} AND {q}) AS \"both\", count(*) FILTER ({p} AND NOT {q}) treatment, count(*) FILTER (NOT {p} AND {q}) baseline, count(*) FILTER (NOT {p} AND NOT {q}) neither FROM gc GROUP BY ALL")
    return " UNION ALL ".join(out)


@query(f"""WITH {_CELLS}, t AS ({_places()}), u AS (SELECT *, CASE WHEN treatment=baseline THEN 1.0 ELSE least(1.0, 2*list_sum(list_transform(range(0, least(treatment,baseline)+1), lambda i: exp(lgamma(treatment+baseline+1)-lgamma(i+1)-lgamma(treatment+baseline-i+1)-(treatment+baseline)*ln(2))))) END p FROM t),
s AS (SELECT *, concat_ws('/', suite, dataset, source_view, group_size, contrast) tn FROM u), v AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY scope) - row_number() OVER (PARTITION BY scope ORDER BY p, tn) + 1)*p) st, row_number() OVER (PARTITION BY scope ORDER BY p, tn) k FROM s)
SELECT scope, suite, dataset, source_view, group_size, contrast, "both", treatment, baseline, neither, round(p,7) p, round(max(st) OVER (PARTITION BY scope ORDER BY k),7) p_holm FROM v""")
def group_transitions(spark, d):
    x = groups.group_transitions(group_cells(spark, d))
    return x.select(*groups.PLACE, "contrast", "both", "treatment", "baseline", "neither", F.round("p", 7).alias("p"), F.round("p_holm", 7).alias("p_holm"))


@query(f"WITH {_CELLS} SELECT cell_id, singleton_state, structured_state, random_state, singleton_correct, structured_correct, random_correct FROM gc")
def answer_states(spark, d):
    x = groups.with_states(group_cells(spark, d))
    return x.select("cell_id", *(f"{a}_state" for a in groups.ARMS), *(f"{a}_correct" for a in groups.ARMS))


# ---- complementarity in full

# fixed values: words that name no family
_FAMILY = "CASE WHEN lower(trim(coalesce(base_family,''))) IN ('','unknown','n/a') THEN 'none' ELSE lower(trim(base_family)) END"
_VALID = "lower(trim(coalesce(llm_status,''))) IN ('success','ok','completed') AND coalesce(llm_prediction,'')<>'' AND llm_prediction<>coalesce(dirty_value,'')"
_COUNTS = "count(*) FILTER (b AND l) n11, count(*) FILTER (b AND NOT l) n10, count(*) FILTER (NOT b AND l) n01, count(*) FILTER (NOT b AND NOT l) n00, count(*) FILTER (v) valid"


def _ratio(top: str, under: str) -> str:
    return f"CASE WHEN {under}=0 THEN NULL ELSE ({top})/({under}) END"


_N = "(n11+n10+n01+n00)"
_FULL = {
    "base_accuracy": _ratio("n11+n10", _N), "llm_accuracy": _ratio("n11+n01", _N), "union_accuracy": _ratio("n11+n10+n01", _N), "union_minus_base": _ratio("n01", _N), "union_minus_best": _ratio("least(n10,n01)", _N),
    "llm_salvage_rate": _ratio("n01", "n01+n00"), "base_rescue_rate": _ratio("n10", "n10+n00"), "disagreement_rate": _ratio("n10+n01", _N), "llm_precision": _ratio("n11+n01", "valid"), "llm_recall": _ratio("n11+n01", _N),
}
_F1 = "CASE WHEN coalesce(llm_precision,0)+coalesce(llm_recall,0)>0 AND llm_precision IS NOT NULL THEN 2*llm_precision*llm_recall/(llm_precision+llm_recall) ELSE 0 END"
_SCOPE = "SELECT '{0}' AS scope, {1} suite, {2} dataset, CAST(sum(n11) AS BIGINT) n11, CAST(sum(n10) AS BIGINT) n10, CAST(sum(n01) AS BIGINT) n01, CAST(sum(n00) AS BIGINT) n00, CAST(sum(valid) AS BIGINT) valid FROM per GROUP BY ALL"


@query(f"""WITH e AS (SELECT suite, dataset, {_FAMILY} family, coalesce(baran_correct,0)=1 b, coalesce(llm_correct,0)=1 l, coalesce({_VALID}, false) v FROM evidence_cells), per AS (SELECT suite, dataset, family, {_COUNTS} FROM e GROUP BY ALL),
c AS ({_SCOPE.format('dataset', 'suite', 'dataset')} UNION ALL {_SCOPE.format('suite', 'suite', "'ALL'")} UNION ALL {_SCOPE.format('family', "'ALL'", 'family')} UNION ALL {_SCOPE.format('micro', "'ALL'", "'MICRO'")}),
r AS (SELECT *, {', '.join(f'{e} {n}' for n, e in _FULL.items())} FROM c), f AS (SELECT *, {_F1} llm_f1 FROM r),
m AS (SELECT * FROM f UNION ALL SELECT 'macro', 'ALL', 'MACRO', CAST(sum(n11) AS BIGINT), CAST(sum(n10) AS BIGINT), CAST(sum(n01) AS BIGINT), CAST(sum(n00) AS BIGINT), CAST(sum(valid) AS BIGINT), {', '.join(f'avg({n})' for n in [*_FULL, 'llm_f1'])} FROM f WHERE scope='dataset')
SELECT scope, suite, dataset, n11, n10, n01, n00, valid, {', '.join(f'round({n},9) {n}' for n in [*_FULL, 'llm_f1'])} FROM m""")
def complementarity_full(spark, d):
    """Eleven rates per data set, suite, family, over all cells and as means of data sets; a rate without cells to divide by is null."""
    family = F.lower(F.trim(F.coalesce("base_family", F.lit(""))))
    e = table(spark, d, "evidence_cells").select(
        "suite", "dataset", F.when(family.isin("", "unknown", "n/a"), "none").otherwise(family).alias("family"), F.coalesce(F.col("baran_correct") == 1, F.lit(False)).alias("b"), F.coalesce(F.col("llm_correct") == 1, F.lit(False)).alias("l"),
        groups.is_valid(F.col("llm_status"), F.lit("ok"), F.lit("propose"), F.col("llm_prediction"), F.col("dirty_value")).alias("v"),
    )
    return metrics.complementarity_full(e, "family", F.col("b"), F.col("l"), F.col("v"))


# ---- paired resampling

_CLUSTER = r"regexp_extract(cell_id, '^(.*:\d+):\d+$', 1)"
_SERIES = "concat_ws('|', method_name, coalesce(backend,'none'), coalesce(group_size_variant,'all'), coalesce(CAST(CAST(round(budget_share*100) AS INT) AS VARCHAR),'none'))"


def _matrix(spark, d):
    r = R._records(spark, d)
    series = F.concat_ws("|", "method_name", F.coalesce("backend", F.lit("none")), F.coalesce("group_size_variant", F.lit("all")), F.coalesce(F.round(F.col("budget_share") * 100).cast("int").cast("string"), F.lit("none")))
    valid = F.coalesce("parse_status", F.lit("")).startswith("ok")
    right = valid & F.coalesce("correct_repair", F.lit(False))
    return metrics.cluster_matrix(r.withColumn("series", series), ["suite", "dataset"], S.row_cluster(F.col("cell_id")), "series", valid, right)


@query(f"WITH fr AS ({R._FR}), x AS (SELECT suite, dataset, {_CLUSTER} cluster, {_SERIES} series, cell_id, bool_or(coalesce(parse_status,'') LIKE 'ok%') v, bool_or(coalesce(parse_status,'') LIKE 'ok%' AND coalesce(correct_repair,false)) r FROM fr GROUP BY ALL) SELECT suite, dataset, cluster, series, count(*) cells, count(*) FILTER (v) valid, count(*) FILTER (r) correct FROM x GROUP BY ALL")
def paired_cluster_matrix(spark, d):
    """Cells, valid and right ones of every series per row of the data set."""
    return _matrix(spark, d)


@query()
def paired_bootstrap(spark, d):
    """Every series against the base, rows being resampled; tested against plain loops with the same draws."""
    m = _matrix(spark, d)
    base = m.where(F.col("series").startswith("base_repair|")).agg(F.min("series")).first()[0]
    return statistics.paired_bootstrap(m, ["suite", "dataset"], "cluster", "series", base or "", 200)


@query()
def multiway_bootstrap(spark, d):
    """Intervals of the gain under weights for rows and columns at once; tested against plain loops with the same draws."""
    e = table(spark, d, "evidence_cells").withColumn("net", F.coalesce("llm_correct", F.lit(0)) - F.coalesce("baran_correct", F.lit(0)))
    return statistics.multiway_bootstrap(e, ["suite"], ["row_cluster", "column_name"], "net", 200)


# ---- candidates of all columns

_SCORES = O.BASE + """,
dom AS (SELECT *, n/sum(n) OVER (PARTITION BY dataset, col_idx) sc FROM (SELECT dataset, col_idx, dirty_value v, count(*) n FROM sound GROUP BY ALL)),
vic AS (SELECT *, k/sum(k) OVER (PARTITION BY dataset, c, j, bv) sc FROM (SELECT a.dataset, a.col_idx c, b.col_idx j, b.dirty_value bv, a.dirty_value v, count(*) k FROM sound a JOIN sound b ON a.dataset=b.dataset AND a.row_idx=b.row_idx AND a.col_idx<>b.col_idx GROUP BY ALL)),
scored AS (SELECT cell_id, v, sc, 'domain' src FROM found JOIN dom USING (dataset, col_idx) UNION ALL SELECT f.cell_id, vic.v, vic.sc, 'vicinity_'||vic.j FROM found f JOIN sound b ON b.dataset=f.dataset AND b.row_idx=f.row_idx AND b.col_idx<>f.col_idx JOIN vic ON vic.dataset=f.dataset AND vic.c=f.col_idx AND vic.j=b.col_idx AND vic.bv=b.dirty_value),
act AS (SELECT cell_id, count(DISTINCT src) a, count(DISTINCT split_part(src,'_',1)) ag, count(DISTINCT v) candidates FROM scored GROUP BY 1),
supp AS (SELECT cell_id, v candidate, round(sum(sc)/max(a), 9) support, count(*) source_count, count(DISTINCT split_part(src,'_',1)) gs FROM scored JOIN act USING (cell_id) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY support DESC, candidate) k FROM supp)
"""


@query(f"WITH {_SCORES} SELECT cell_id, candidate, support, source_count, CAST(k AS INT) AS rank FROM rk WHERE k <= 10")
def candidate_ranks(spark, d):
    """The ten best candidates of every error cell of both tables."""
    return candidates.ranked_candidates(spark, O.sound(spark, d), O.found(spark, d))


@query(f"""WITH {_SCORES}, f1 AS (SELECT * FROM rk WHERE k=1), f2 AS (SELECT cell_id, support s2 FROM rk WHERE k=2), own AS (SELECT rk.* FROM rk JOIN found USING (cell_id) JOIN base_values USING (dataset, col_idx) WHERE rk.candidate=base_value)
SELECT f1.cell_id, a.candidates candidate_count, f1.support top_support, coalesce(s2,0) second_support, round(f1.support-coalesce(s2,0),8) support_margin, coalesce(own.support, f1.support) predicted_support, round(coalesce(own.source_count, f1.source_count)/a.a,8) source_agreement, round(coalesce(own.gs, f1.gs)/a.ag,8) source_group_agreement, coalesce(own.source_count, f1.source_count) source_vote_count, a.a source_model_count, coalesce(own.candidate, f1.candidate)=f1.candidate predicted_is_top
FROM f1 JOIN act a USING (cell_id) LEFT JOIN f2 USING (cell_id) LEFT JOIN own ON own.cell_id=f1.cell_id""")
def candidate_diagnostics(spark, d):
    predictions = O.found(spark, d).join(O.base_values(spark, d), ["dataset", "col_idx"]).select("cell_id", F.col("base_value").alias("prediction"))
    return candidates.candidate_diagnostics(spark, O.sound(spark, d), O.found(spark, d), predictions)


# ---- costs, interference, coverage of generated queries

_INDEX = ["method_name", "backend", "scenario", "group_size_variant", "suite", "dataset"]


@query(f"SELECT {', '.join(_INDEX)}, budget_pct, count(*) calls, CAST(sum(length(coalesce(prediction,''))) AS BIGINT) tokens, count(*) FILTER (prediction IS NULL) unknown FROM (SELECT *, CAST(round(budget_share*100) AS INT) budget_pct FROM final_records) GROUP BY ALL")
def cost_index(spark, d):
    """Calls, known tokens (the length of a prediction) and unknown ones per back end, scenario, variant, budget and data set."""
    r = table(spark, d, "final_records").withColumns({"budget_pct": F.round(F.col("budget_share") * 100).cast("int"), "tokens": F.length("prediction")})
    return metrics.cost_index(r, [*_INDEX, "budget_pct"], "tokens")


@query("WITH c AS (SELECT phase, @query_id q, coalesce(@prompt_hash,'') p, arg_max({'s': status, 'a': attempts, 'h': cache_hit}, delivery_id) z, count(*) n FROM group_checkpoint WHERE query_id IS NOT NULL GROUP BY ALL), per AS (SELECT phase, count(*) identities, CAST(sum(n) AS BIGINT) physical_rows, count(*) FILTER (z.s='success') resolved, count(*) FILTER (z.s IS DISTINCT FROM 'success') unresolved, CAST(sum(z.a) AS BIGINT) attempts FROM c GROUP BY 1) SELECT coalesce(phase,'none') phase, identities, physical_rows, resolved, unresolved, attempts FROM per UNION ALL SELECT 'TOTAL', CAST(sum(identities) AS BIGINT), CAST(sum(physical_rows) AS BIGINT), CAST(sum(resolved) AS BIGINT), CAST(sum(unresolved) AS BIGINT), CAST(sum(attempts) AS BIGINT) FROM per")
def api_cost_total(spark, d):
    """Per phase and in all: identities by their last row, physical rows, what was resolved, attempts."""
    return metrics.phase_costs(R._checkpoint(spark, d).withColumn("p", F.coalesce("prompt_hash", F.lit(""))), "phase", ["q", "p"], "delivery_id")


@query(f"WITH {_CELLS} SELECT source_view, group_size, count(*) n, round(avg(CAST(singleton_correct AS INT)),9) singleton_accuracy, round(avg(CAST(structured_correct AS INT)),9) group_accuracy, count(*) FILTER (structured_correct AND NOT singleton_correct) rescued, count(*) FILTER (singleton_correct AND NOT structured_correct) interfered FROM gc GROUP BY ALL")
def batch_interference_views(spark, d):
    """Right answers alone and in groups by view and size."""
    x = groups.with_states(group_cells(spark, d)).withColumn("group_size", F.col("group_size").cast("string"))
    return metrics.interference(x, ["source_view", "group_size"], F.col("singleton_correct"), F.col("structured_correct"))


@query(f"WITH {W._ACTIONS}, m AS (SELECT dataset, unnest(ids) cell_id, size FROM actions), k AS (SELECT dataset, cell_id, count(*) n, max(size) s FROM m GROUP BY ALL) SELECT dataset, count(*) cells, min(n) min_memberships, median(n) median_memberships, max(n) max_memberships, round(count(*) FILTER (s>1)/count(*),8) group_coverage FROM k GROUP BY dataset")
def membership_audit(spark, d):
    """How often cells are asked, and the share that some group holds."""
    return metrics.membership_audit(W._actions(spark, d), ["dataset"])


@query("SELECT suite, avg(h) helpful_rate, avg(m) harmful_rate, count(*) n FROM (SELECT suite, CAST(llm_status='completed' AND coalesce(llm_correct,0)=1 AND coalesce(baran_correct,0)<>1 AS INT) h, CAST(llm_status='completed' AND coalesce(baran_correct,0)=1 AND coalesce(llm_correct,0)<>1 AS INT) m FROM (SELECT suite, coalesce(llm_status,'') llm_status, llm_correct, baran_correct FROM evidence_cells)) GROUP BY suite")
def positive_rates(spark, d):
    e = table(spark, d, "evidence_cells").withColumn("x", F.coalesce(F.col("llm_status") == "completed", F.lit(False)))
    t = gate.uplift_targets(e, "baran_correct", "llm_correct", "x")
    return t.groupBy("suite").agg(F.avg("helpful").alias("helpful_rate"), F.avg("harmful").alias("harmful_rate"), F.count("*").alias("n"))


@query("SELECT field, count(*) FILTER (missing) missing, count(*) AS rows FROM (" + " UNION ALL ".join(f"SELECT '{c}' field, {c} IS NULL OR trim(CAST({c} AS VARCHAR))='' missing FROM final_records" for c in ("method_name", "backend", "cell_id", "prediction", "parse_status", "correct_repair")) + ") GROUP BY field")
def missing_fields(spark, d):
    return audit.missing_fields(table(spark, d, "final_records"), ["method_name", "backend", "cell_id", "prediction", "parse_status", "correct_repair"])


@query("WITH s AS (SELECT suite, dataset, coalesce(llm_observed_total_tokens,0)%100/100.0::DOUBLE sc, CAST(coalesce(llm_correct,0)=1 AS INT) y FROM evidence_cells), g AS (SELECT suite, dataset, sc, sum(y) p, count(*) n, sum((sc-y)*(sc-y)) se FROM s GROUP BY ALL), w AS (SELECT *, sum(p) OVER (PARTITION BY suite, dataset ORDER BY sc DESC) tp, sum(n) OVER (PARTITION BY suite, dataset ORDER BY sc DESC) seen FROM g), per AS (SELECT suite, dataset, CASE WHEN sum(p)>0 THEN sum(p*tp/seen)/sum(p) ELSE 0 END ap, sum(se)/sum(n) brier, sum(p)/sum(n) prev FROM w GROUP BY ALL) SELECT suite, count(*) datasets, round(avg(ap),9) average_precision, round(avg(brier),9) brier, round(avg(prev),9) prevalence FROM per GROUP BY suite")
def routeability_macro(spark, d):
    """Means over the data sets of a suite."""
    e = table(spark, d, "evidence_cells").select("suite", "dataset", (F.coalesce("llm_observed_total_tokens", F.lit(0)) % 100 / 100.0).alias("score"), F.coalesce(F.col("llm_correct") == 1, F.lit(False)).cast("int").alias("label"))
    per = metrics.average_precision(e, ["suite", "dataset"], "score", "label")
    return per.groupBy("suite").agg(F.count("*").alias("datasets"), *(F.round(F.avg(c), 9).alias(c) for c in ("average_precision", "brier", "prevalence")))
