"""Verification of candidate repairs and the choice among them, as expressions over one row per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.functions.scalars import format_signature, value_type

MINIMUM_GAIN, MINIMUM_CONFIDENCE, ACCEPTANCE = 0.0, 0.55, 0.55


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def fallback_value(status: Column, prediction: Column, dirty: Column) -> Column:
    """The base value counts only where its status starts with ok, else the dirty value stands."""
    return F.when(F.coalesce(status, F.lit("")).startswith("ok"), F.coalesce(prediction, F.lit(""))).otherwise(dirty)


def decide(c: DataFrame, minimum_gain: float = MINIMUM_GAIN, minimum_confidence: float = MINIMUM_CONFIDENCE, acceptance: float = ACCEPTANCE, comparative: bool = True) -> DataFrame:
    """Adds reason, score, accepted and final_prediction.

    Needs: parse_status, decision, candidate (normalised, null where there is none), dirty_value,
    fallback, confidence, uplift, dominant_type, dominant_format, candidate_support, fallback_support,
    fd_before, fd_after. The tests come in a fixed order and the first that fails gives the reason.
    comparative: a candidate must be better than the fallback in support, conflicts, type or format. Null
    and NaN confidences and uplifts count as 0; null supports and conflicts count as 0.
    """
    soft_type = F.col("dominant_type").isin("text", "empty")
    type_ok = lambda v: (value_type(v) == F.col("dominant_type")) | soft_type
    form_ok = lambda v: (format_signature(v) == F.col("dominant_format")) | (F.col("dominant_type") == "text")
    cand, base = F.col("candidate"), F.col("fallback")
    c = c.withColumns({"type_ok": type_ok(cand), "base_type_ok": type_ok(base), "format_ok": form_ok(cand), "base_format_ok": form_ok(base)})
    number = lambda name: F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    zero = lambda name: F.coalesce(name, F.lit(0))
    c = c.withColumns({"uplift": number("uplift"), "fd_before": zero("fd_before"), "fd_after": zero("fd_after")})
    support, fd = zero("candidate_support") > zero("fallback_support"), F.col("fd_after") < F.col("fd_before")
    conf = _clamp(number("confidence"))
    # summed in this order, so that a score at the threshold is decided by the same double everywhere
    score = 0.40 * conf + 0.25 * _clamp(F.col("uplift") / 0.5) + 0.10 * F.col("type_ok").cast("int") + 0.05 * F.col("format_ok").cast("int") + 0.10 * support.cast("int") + 0.10 * fd.cast("int")
    signal = support | fd | (F.col("type_ok") & ~F.col("base_type_ok")) | (F.col("format_ok") & ~F.col("base_format_ok"))
    reason = (
        F.when(~F.coalesce(F.col("parse_status").isin("ok", "partial", "ok_item"), F.lit(True)), "invalid_llm_output")
        .when(~F.coalesce(F.lower(F.trim("decision")) == "propose", F.lit(False)), "fallback_decision")
        .when(cand.isNull(), "missing_repair")
        .when(cand == "", "empty_repair")
        .when(cand == F.col("dirty_value"), "unchanged_dirty_value")
        .when(cand == base, "equivalent_to_base")
        .when((F.col("uplift") <= 0) | (F.col("uplift") < minimum_gain), "non_positive_predicted_gain")
        .when(conf < minimum_confidence, "low_llm_confidence")
        .when(F.col("fd_after") > F.col("fd_before"), "public_fd_worse")
        .when(~F.col("type_ok") & F.col("base_type_ok") & ~fd, "type_worse_than_base")
        .when(~F.col("format_ok") & F.col("base_format_ok") & ~fd, "format_worse_than_base")
    )
    if comparative:
        reason = reason.when(~signal, "no_comparative_signal")
    reason = reason.when(score < acceptance, "verification_score_below_threshold").otherwise("accepted")
    reached = F.col("reason").isin("accepted", "verification_score_below_threshold")
    c = c.withColumn("reason", reason).withColumn("score", F.when(reached, F.round(score, 9)).otherwise(0.0)).withColumn("accepted", F.col("reason") == "accepted")
    return c.withColumn("final_prediction", F.when(F.col("accepted"), cand).otherwise(base)).drop("type_ok", "base_type_ok", "format_ok", "base_format_ok")


def arbitrate(decided: DataFrame, cell: str = "cell_id") -> DataFrame:
    """One row per cell: the first accepted candidate by uplift, cost, size and query id, else the base value."""
    order = F.struct((~F.col("accepted")).cast("int"), -F.col("uplift"), "query_cost", "query_size", "query_id")
    best = decided.groupBy(cell).agg(F.min_by(F.struct("accepted", "query_id", "candidate", "fallback"), order).alias("b"), F.count("*").alias("candidates"), F.sum(F.col("accepted").cast("int")).alias("accepted_candidates"))
    won = F.col("b.accepted")
    return best.select(cell, F.when(won, F.col("b.query_id")).alias("query_id"), F.when(won, F.col("b.candidate")).otherwise(F.col("b.fallback")).alias("final_prediction"), F.when(won, "llm").otherwise("base").alias("final_source"), "candidates", "accepted_candidates")


def alone_record(status: Column, parse_status: Column, decision: Column, candidate: Column, dirty: Column) -> dict[str, Column]:
    """prediction and parse_status of a cell that is repaired by its single answer alone; what isn't usable leaves the dirty value."""
    said, value = F.lower(F.trim(F.coalesce(decision, F.lit("")))), F.coalesce(candidate, F.lit(""))
    state = (
        F.when(~F.coalesce(status.isin("success", "ok", "completed"), F.lit(False)), "provider_failure").when(~F.coalesce(parse_status.isin("ok", "partial"), F.lit(False)), "parse_failure").when(said == "", "missing_item")
        .when(said == "abstain", "abstain").when(value == "", "empty_repair").when(value == dirty, "unchanged_dirty").otherwise("ok")
    )
    return {"prediction": F.when(state == "ok", value).otherwise(dirty), "parse_status": state}


def transfer_outcomes(decided: DataFrame, keys: list[str], truth: str = "clean_value") -> DataFrame:
    """(keys, candidates, accepted, rescued, harmed, neutral, abstained, unparsed): what answers change against the fallback."""
    n = lambda c: F.sum(c.cast("int"))
    took, was, now = F.col("accepted"), F.coalesce(F.col("fallback") == F.col(truth), F.lit(False)), F.coalesce(F.col("final_prediction") == F.col(truth), F.lit(False))
    return decided.groupBy(*keys).agg(F.count("*").alias("candidates"), n(took).alias("accepted"), n(took & now & ~was).alias("rescued"), n(took & was & ~now).alias("harmed"), n(took & (was == now)).alias("neutral"), n(F.col("reason") == "fallback_decision").alias("abstained"), n(F.col("reason") == "invalid_llm_output").alias("unparsed"))
