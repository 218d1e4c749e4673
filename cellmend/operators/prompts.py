"""What is shown to a model: payloads, messages, their ids, costs, and what must never be in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.functions.scalars import bounded, completion_ceiling, token_estimate

# fixed values: names that must not be keys of a payload
FORBIDDEN_KEYS = [
    "baran", "baran_candidate", "baran_confidence", "baran_correct", "baran_prediction", "candidate_support", "clean", "clean_value", "correct_repair", "corrector_support", "error_type", "llm_correct", "missing_value",
    "right_value", "source_agreement", "tuple_pairs",
]
# fixed values: patterns that must not occur in a text
FORBIDDEN_TEXT = [
    "baran[_ -]?(candidate|prediction|support|confidence|correct)", "candidate[_ -]?support", "clean[_ -]?value", "correct[_ -]?repair", "corrector[_ -]?support", "error[_ -]?type", "llm[_ -]?correct",
    "missing[_ -]?value", "right[_ -]?value", "source[_ -]?agreement", "tuple[_ -]?pairs",
]
SYSTEM = "Repair the listed cells. Answer with one JSON object holding query_id and repairs."


def canonical_json(**fields: Column) -> Column:
    """An object with sorted keys, nulls kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def query_id(dataset: Column, cell_ids: Column) -> Column:
    """24 hex digits of a data set and a set of cells, whatever their order."""
    return F.substring(F.sha2(canonical_json(dataset=dataset, cell_ids=F.array_sort(F.array_distinct(cell_ids))), 256), 1, 24)


def ordered_query_id(dataset: Column, cell_ids: Column) -> Column:
    """As query_id, but another order is another query."""
    return F.substring(F.sha2(canonical_json(dataset=dataset, ordered_cell_ids=cell_ids), 256), 1, 24)


def request_hash(model: Column, prompt_hash: Column, ceiling: Column) -> Column:
    return F.sha2(canonical_json(model=model, prompt_hash=prompt_hash, max_tokens=ceiling), 256)


def with_prompts(actions: DataFrame, cells: DataFrame, masked: DataFrame) -> DataFrame:
    """actions (query_id, dataset, cell_ids) with payload, prompt_hash, prompt_tokens and completion_ceiling instead of the cell ids.

    cells: cell_id, column_name, dirty_value; masked: cell_id, masked. Members come in the order of their
    ids; a query has at most a few members, so their list is short by construction. Actions are read once:
    what else they hold goes along with their members.
    """
    each = cells.select("cell_id", "column_name", bounded(F.col("dirty_value")).alias("dirty_value")).join(masked, "cell_id")
    shown = F.struct("cell_id", F.col("column_name").alias("column"), "dirty_value", F.col("masked").alias("row"))
    kept = [*(c for c in actions.columns if c != "cell_ids"), "_k"]
    members = actions.withColumn("_k", F.size("cell_ids")).select(*kept, F.explode("cell_ids").alias("cell_id")).join(each.select("cell_id", shown.alias("_shown")), "cell_id")
    x = members.groupBy(*kept).agg(F.array_sort(F.collect_list("_shown")).alias("cells")).withColumn("payload", canonical_json(query_id=F.col("query_id"), dataset=F.col("dataset"), cells=F.col("cells"))).drop("cells")
    messages = F.concat_ws("\n", F.lit(SYSTEM), "payload")
    return x.withColumns({"prompt_hash": F.sha2(messages, 256), "prompt_tokens": token_estimate(messages), "completion_ceiling": completion_ceiling(F.col("_k"))}).drop("_k")


def one_per_prompt(actions: DataFrame) -> DataFrame:
    """actions with a prompt_hash, one for each prompt: the one with the smallest query_id."""
    rest = [c for c in actions.columns if c != "prompt_hash"]
    top = actions.groupBy("prompt_hash").agg(F.min_by(F.struct(*rest), "query_id").alias("_r"))
    return top.select("prompt_hash", "_r.*").select(*actions.columns)


def leaks(payload: Column) -> Column:
    """Whether a JSON text has one of the forbidden names as a key, at any depth."""
    return F.lower(payload).rlike('"(' + "|".join(FORBIDDEN_KEYS) + r')"\s*:')


def text_leaks(text: Column) -> Column:
    """Whether a text has one of the forbidden patterns, in any letter case."""
    return text.rlike("(?i)" + "|".join(FORBIDDEN_TEXT))


def price(tokens: Column, tiers: list[tuple[int | None, float]]) -> Column:
    """The price of the first tier that holds the tokens; the last tier may be open."""
    out = None
    for top, value in tiers:
        fits = F.lit(True) if top is None else tokens <= top
        out = F.when(fits, F.lit(value)) if out is None else out.when(fits, F.lit(value))
    return out
