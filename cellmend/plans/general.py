"""The general data problems on the project's tables."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.functions.scalars import normalize_value
from cellmend.operators.deliveries import RepeatedDeliveries
from cellmend.operators.instants import to_instants
from cellmend.operators.reconcile import SetReconciliation
from cellmend.plans.registry import digest_sql
from cellmend.sources.tables import table


def budget_key(share):
    """Shares closer than 1e-9 fall together: to the next millionth where that is closer than 1e-9, else to 1e-9."""
    share = F.when(~F.isnan(share), share)
    near = F.round(share, 6)
    return F.when(F.abs(share - near) < 1e-9, near).otherwise(F.round(share, 9)) + F.lit(0.0)


def verdict(column, kind: str):
    """true, false or null; of a text, 1, true, yes and y in any letter case are true."""
    return F.lower(column).isin("1", "true", "yes", "y") if kind == "string" else column.cast("boolean")


def _ledger(df: DataFrame) -> tuple[dict, dict]:
    keys = {"method_name": F.col("method_name"), "backend": F.col("backend"), "budget": budget_key(F.col("budget_share")), "cell_id": F.col("cell_id")}
    fields = {"prediction": normalize_value(F.col("prediction")), "correct_repair": verdict(F.col("correct_repair"), dict(df.dtypes)["correct_repair"]), "parse_status": F.col("parse_status")}
    return keys, fields


def ledger_differences(spark: SparkSession, first: DataFrame, second: DataFrame, **options) -> DataFrame:
    """Keys held by one copy only and fields that differ, of two copies of the final ledger.

    A null budget share is a key value of its own (budget_pct -1), NaN counts as null. Further columns
    are not looked at.
    """
    (ka, fa), (kb, fb) = _ledger(first), _ledger(second)
    found = SetReconciliation(spark, **options).compare(first, second, (ka, kb), (fa, fb), "row_index")
    pct = F.coalesce(F.round(F.col("budget") * 100).cast("int"), F.lit(-1))
    return found.select("method_name", "backend", pct.alias("budget_pct"), "cell_id", "difference")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger_differences(spark, table(spark, d, "final_records"), table(spark, d, "final_records_replay"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return to_instants(table(spark, d, "clean"), ["sched_dep_time", "act_dep_time", "act_arr_time"], table(spark, d, "sources"), ["row_id"])


def _messages(spark: SparkSession) -> RepeatedDeliveries:
    return RepeatedDeliveries(spark, ["query_id", "prompt_hash", "provider_request_hash"], required="query_id", blank_is_null=("provider_request_hash",))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark).repeats(table(spark, d, "group_checkpoint"))


def p5_messages(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark).messages(table(spark, d, "group_checkpoint"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found, "p5_messages": p5_messages}

_MESSAGE = f"{digest_sql('query_id')}, {digest_sql('prompt_hash')}, nullif({digest_sql('provider_request_hash')}, '')"
_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY {_MESSAGE} ORDER BY received_at NULLS LAST, delivery_id) k FROM group_checkpoint"
#: the named entities of HTML 4, as a map from entity to text
_NAMED = "MAP {" + ", ".join(f"'&{n};': chr({c})" for n, c in name2codepoint.items()) + "}"


def normalized_sql(value: str) -> str:
    """normalize_value for texts whose entities are numbers or the common names."""
    one = f"CASE WHEN t LIKE '&#x%;' OR t LIKE '&#X%;' THEN chr(CAST('0x' || substr(t, 4, length(t) - 4) AS INT)) WHEN t LIKE '&#%;' THEN chr(CAST(substr(t, 3, length(t) - 3) AS INT)) WHEN t LIKE \'&_%;\' THEN coalesce({_NAMED}[t], t) ELSE t END"
    plain = f"array_to_string(list_transform(regexp_extract_all(coalesce({value}, ''), '&#[xX][0-9a-fA-F]+;|&#[0-9]+;|&[A-Za-z0-9]+;|[^&]+|&'), lambda t: {one}), '')"
    return f"trim(regexp_replace({plain}, '[\\t\\n ]+', ' ', 'g'), ' ')"


def _copy(name: str, right: str) -> str:
    return f"SELECT method_name, backend, b, cell_id, arg_max({{'p': {normalized_sql('prediction')}, 'c': {right}, 's': parse_status}}, row_index) x FROM (SELECT *, round(budget_share, 8) b FROM {name}) GROUP BY ALL"


SQL = {
    "p1_found": f"""WITH a AS ({_copy('final_records', 'correct_repair')}), c AS ({_copy('final_records_replay', "CASE WHEN correct_repair IS NOT NULL THEN lower(correct_repair) IN ('1','true','yes','y') END")}),
u AS (SELECT method_name, backend, b, cell_id, any_value(x) x, any_value(y) y FROM (SELECT method_name, backend, b, cell_id, x, NULL y FROM a UNION ALL SELECT method_name, backend, b, cell_id, NULL, x FROM c) GROUP BY ALL)
SELECT method_name, backend, CAST(coalesce(round(b * 100), -1) AS INT) budget_pct, cell_id, unnest(CASE WHEN x IS NULL THEN ['missing_first'] WHEN y IS NULL THEN ['missing_second'] ELSE list_filter([CASE WHEN x.p IS DISTINCT FROM y.p THEN 'prediction' END, CASE WHEN x.c IS DISTINCT FROM y.c THEN 'correct_repair' END, CASE WHEN x.s IS DISTINCT FROM y.s THEN 'parse_status' END], lambda d: d IS NOT NULL) END) difference FROM u""",
    "p5_found": f"SELECT delivery_id FROM ({_NUMBERED}) WHERE query_id IS NOT NULL AND k > 1",
    "p5_messages": f"SELECT * EXCLUDE (k) FROM ({_NUMBERED}) WHERE query_id IS NULL OR k = 1",
}
