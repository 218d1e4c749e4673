"""Audits of answers that are used again: identities, reuse, plans, executions, and whether a run holds together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.operators.audit import content_digest, field_differences
from cellmend.operators.contracts import metric_delta_rows
from cellmend.operators.ledger import latest, parse_responses

# fixed values: roles of rows in a merged ledger, and what a change in them is put down to
CAUSES = {"bank": "cache_union", "supplemental": "supplemental"}


class TokenCapExceeded(RuntimeError):
    """A batch whose worst case would cross the cap."""


def token_cap(given: int | None, configured: int | None, uncapped: bool = False) -> int | None:
    """The cap that holds: the given one before the configured one, none only where that is said."""
    if uncapped:
        return None
    cap = given if given is not None else configured
    if cap is None:
        raise ValueError("a token cap must be given, or its absence stated")
    if cap <= 0:
        raise ValueError("a token cap must be positive")
    return int(cap)


def reserve(spent: int, planned: int, cap: int | None, attempts: int) -> int:
    """What a batch may cost at worst, refused where that and what is spent cross the cap."""
    worst = spent + attempts * max(0, planned)
    if cap is not None and worst > cap:
        raise TokenCapExceeded(f"{worst} tokens at worst, {cap} at most")
    return worst


def provider_debit(ledger: DataFrame, known: str, estimate: str, attempts: str, unknown: str, cached: str) -> DataFrame:
    """One row (debit): known usage, and the estimate for every attempt whose usage isn't known; answers from a cache cost nothing."""
    number = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c).cast("long"), F.lit(0)))
    paid = ledger.where(~F.coalesce(F.col(cached).cast("boolean"), F.lit(False)))
    cost = F.when(F.col(known).isNull(), number(estimate) * F.greatest(F.lit(1), number(attempts))).otherwise(number(known) + number(estimate) * number(unknown))
    return paid.agg(F.coalesce(F.sum(cost), F.lit(0)).cast("long").alias("debit"))


def identity_drift(rows: DataFrame, requests: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after): fields in which rows differ from the request they answer, null being equal to null."""
    return field_differences(requests.select(key, *fields), rows.select(key, *fields), [key], fields)


def matching_identity(rows: DataFrame, requests: DataFrame, fields: list[str]) -> DataFrame:
    """Rows that agree with a request in all of its identity fields; a null field agrees with none."""
    return rows.join(requests.select(*fields).distinct(), fields, "left_semi")


def inconsistent_rows(ledger: DataFrame, success: list[str], failure: list[str]) -> DataFrame:
    """ledger (status, parse_status, response_text) with `reason`: rows that contradict themselves.

    A status must be one of both lists; a success has a text and a parse status, a failure no parsed answer.
    """
    ok, failed = F.coalesce(F.col("status").isin(*success), F.lit(False)), F.coalesce(F.col("status").isin(*failure), F.lit(False))
    text, parsed = F.coalesce(F.trim("response_text"), F.lit("")) != "", F.coalesce("parse_status", F.lit(""))
    reason = (
        F.when(~ok & ~failed, "unknown_status").when(ok & ~text, "success_without_text").when(ok & (parsed == ""), "success_without_parse_status").when(failed & parsed.isin("ok", "partial"), "failure_with_answer")
    )
    return ledger.withColumn("reason", reason).where("reason is not null")


def parse_drift(ledger: DataFrame) -> DataFrame:
    """ledger rows whose stored parse status isn't what parsing their text again gives, with the latter as `parsed_status`."""
    again = parse_responses(ledger).withColumn("parsed_status", F.col("parsed.parse_status")).drop("parsed")
    return again.where(~F.col("parse_status").eqNullSafe(F.col("parsed_status")))


def evidence_drift(cells: DataFrame, base_prediction: str, base_correct: str, llm_prediction: str, llm_correct: str, quadrant: str) -> DataFrame:
    """cells with `reason`: stored verdicts that values don't bear out, and quadrants that verdicts don't.

    Values are compared as they are, null being the empty text; a null verdict counts as wrong.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    b, m = F.coalesce(F.col(base_correct) == 1, F.lit(False)), F.coalesce(F.col(llm_correct) == 1, F.lit(False))
    expected = F.concat(F.lit("n_"), b.cast("int").cast("string"), m.cast("int").cast("string"))
    reason = (
        F.when(b != (text(base_prediction) == text("clean_value")), "base_verdict").when(m & (text(llm_prediction) != text("clean_value")), "llm_verdict").when(~F.col(quadrant).eqNullSafe(expected), "quadrant")
    )
    return cells.withColumn("reason", reason).where("reason is not null")


def reusable(requests: DataFrame, ledger: DataFrame, model: str | Column, order: list[str]) -> DataFrame:
    """requests (q, prompt_hash, request_hash, schema) that an older ledger has, with `outcome`: imported, or why not.

    Of the ledger (q, prompt_hash, request_hash, schema, model, status) the last row per query and prompt of
    the wanted model counts; a request without one has no row. The tests come in a fixed order.
    """
    last = latest(ledger.where(F.col("model") == model), ["q", "prompt_hash"], order)
    x = requests.join(last.select("q", "prompt_hash", F.col("request_hash").alias("_h"), F.col("schema").alias("_v"), "status"), ["q", "prompt_hash"])
    outcome = F.when(~F.coalesce(F.col("status") == "success", F.lit(False)), "not_successful").when(~F.col("schema").eqNullSafe(F.col("_v")), "schema_mismatch").when(~F.col("request_hash").eqNullSafe(F.col("_h")), "request_hash_mismatch").otherwise("imported")
    return x.withColumn("outcome", outcome).select(*requests.columns, "outcome")


def union_plan(requests: DataFrame, ledger: DataFrame, identity: list[str], order: list[str], estimate: str, freeze_failures: bool = False) -> DataFrame:
    """requests with `state` (cached_success, cached_failure, online) and the tokens still to be asked for.

    The last row of an identity counts. A failure is asked again unless failures are frozen.
    """
    last = latest(ledger, identity, order).select(*identity, F.col("status").alias("_status"), F.lit(True).alias("_known"))
    state = F.when(F.coalesce(F.col("_status") == "success", F.lit(False)), "cached_success").when(F.col("_known"), "cached_failure").otherwise("online")
    x = requests.join(last, identity, "left").withColumn("state", state)
    asked = (F.col("state") == "online") if freeze_failures else (F.col("state") != "cached_success")
    return x.withColumn("online_tokens", F.when(asked, F.greatest(F.lit(0), F.coalesce(F.col(estimate), F.lit(0)))).otherwise(0).cast("long")).drop("_status", "_known")


def plan_totals(plan: DataFrame, debit: int, attempts: int) -> DataFrame:
    """One row: requests by state, tokens still to be asked for, and the cap that retries need."""
    n = lambda s: F.sum((F.col("state") == s).cast("int"))
    t = F.coalesce(F.sum("online_tokens"), F.lit(0))
    return plan.agg(F.count("*").alias("requests"), *(F.coalesce(n(s), F.lit(0)).alias(s) for s in ("cached_success", "cached_failure", "online")), t.alias("online_tokens"), (F.lit(debit) + attempts * t).cast("long").alias("retry_adjusted_cap"))


def metric_mismatches(computed: DataFrame, reported: DataFrame, keys: list[str], whole: list[str], real: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Fields of computed rows that reported ones don't bear out: whole numbers exactly, others within the tolerance."""
    exact = metric_delta_rows(reported, computed, keys, whole, 0.0)
    return exact.unionByName(metric_delta_rows(reported, computed, keys, real, tolerance)).where("state <> 'same'")


def reuse_audit(ledger: DataFrame, query: str, prompt: str, request: str, cells: str, order: list[str]) -> DataFrame:
    """(query, history, prompt_hashes, request_hashes, cells, reason): queries asked for one cell whose rows can't stand for one request.

    reason: the first of prompt_drift, request_drift, not_singleton that holds. Null digests count as one
    digest of their own.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    per = ledger.groupBy(query).agg(
        F.count("*").alias("history"), F.countDistinct(text(prompt)).alias("prompt_hashes"), F.countDistinct(text(request)).alias("request_hashes"), F.max_by(F.coalesce(F.size(cells), F.lit(0)), F.struct(*order)).alias("cells"),
        F.min((text(prompt) != "").cast("int")).alias("_p"), F.min((text(request) != "").cast("int")).alias("_r"),
    )
    reason = F.when((F.col("prompt_hashes") != 1) | (F.col("_p") == 0), "prompt_drift").when((F.col("request_hashes") != 1) | (F.col("_r") == 0), "request_drift").when(F.col("cells") != 1, "not_singleton")
    return per.withColumn("reason", reason).drop("_p", "_r")


def execution_differences(old: DataFrame, new: DataFrame, query: str, identity: list[str], content: list[str], role: str = "role") -> DataFrame:
    """(query, drift, changed_fields, cause): queries of both executions whose identity or content differs.

    cause: by the role of the new row; a change in another role has the cause `unsupported`. Queries of one
    execution only are in `coverage`.
    """
    fields = [*identity, *content]
    row = lambda df, s: df.select(query, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(s), *([F.col(role).alias("_role")] if s == "y" else []))
    both = row(old, "x").join(row(new, "y"), query)
    differ = lambda names: F.filter(F.array(*(F.when(~F.col("x")[f].eqNullSafe(F.col("y")[f]), F.lit(f)) for f in sorted(names))), lambda f: f.isNotNull())
    x = both.select(query, (F.size(differ(identity)) > 0).alias("drift"), differ(content).alias("changed_fields"), "_role")
    cause = reduce(lambda c, i: c.when(F.col("_role") == i[0], i[1]), CAUSES.items(), F.when(F.size("changed_fields") == 0, F.lit(None).cast("string"))).otherwise("unsupported")
    return x.where("drift or size(changed_fields) > 0").select(query, "drift", F.array_join("changed_fields", ",").alias("changed_fields"), cause.alias("cause"))


def selected_executions(selected: DataFrame, ledger: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """The last ledger row of every selected identity; one without a row has nulls and found = false."""
    last = latest(ledger, identity, order).withColumn("found", F.lit(True))
    return selected.select(*identity).distinct().join(last, identity, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def contract(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """One row (rows, distinct_keys, null_keys, ok): whether keys are whole and unique, and the rows as many as stated."""
    lacks = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    x = df.agg(F.count("*").alias("rows"), F.countDistinct(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys)).alias("distinct_keys"), F.coalesce(F.sum(lacks.cast("int")), F.lit(0)).alias("null_keys"))
    ok = (F.col("rows") == F.col("distinct_keys")) & (F.col("null_keys") == 0)
    return x.withColumn("ok", ok & (F.col("rows") == rows) if rows is not None else ok)


def overlaps(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """(column, shared): different values of each column that both sides hold; a clean split shares none."""
    parts = []
    for c in columns:
        side = lambda df: df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct()  # noqa: E731, B023
        parts.append(side(train).join(side(test), "v", "left_semi").agg(F.count("*").alias("shared")).select(F.lit(c).alias("column"), "shared"))
    return reduce(DataFrame.unionByName, parts)


def same_order(old: DataFrame, new: DataFrame, slices: list[str], place: str, query: str = "query_id") -> DataFrame:
    """(slices, equal): whether both choose the same queries in the same order, in every slice of either.

    A slice's queries are digested in order in one aggregation; a choice is bounded by its budget.
    """
    side = lambda df, s: df.groupBy(*slices).agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(place, query))), lambda x: x[query])), 256).alias(s))
    return side(old, "a").join(side(new, "b"), slices, "full_outer").select(*slices, F.col("a").eqNullSafe(F.col("b")).alias("equal"))


def bindings(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, digest): what a run is bound to. The digest is that of the rows whatever their order."""
    parts = [content_digest(df, [F.col(c) for c in sorted(df.columns)]).select(F.lit(n).alias("name"), "rows", "digest") for n, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def binding_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, state): tables that lack, are new, or changed in rows or content."""
    e, a = (df.select("name", F.struct("rows", "digest").alias(s)) for df, s in ((expected, "e"), (actual, "a")))
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("e.rows") != F.col("a.rows"), "rows").when(F.col("e.digest") != F.col("a.digest"), "content")
    return e.join(a, "name", "full_outer").select("name", state.alias("state")).where("state is not null")


def validation(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations, ok): a run holds together if none of its checks finds a row."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(n).alias("check"), "violations", (F.col("violations") == 0).alias("ok")) for n, df in sorted(checks.items())]
    return reduce(DataFrame.unionByName, parts)


def acceptance(counts: DataFrame, expected: dict[str, int], name: str = "name", rows: str = "rows") -> DataFrame:
    """(name, rows, expected, ok): numbers of rows that a report must have."""
    want = counts.sparkSession.createDataFrame(sorted(expected.items()), f"{name} string, expected long")
    x = want.join(counts.select(name, F.col(rows).cast("long").alias("rows")), name, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return x.select(name, "rows", "expected", (F.col("rows") == F.col("expected")).alias("ok"))
