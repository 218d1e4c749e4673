"""The scalar and table functions for use in SQL: `register(spark)`, then `SELECT value_type(normalize_value(x))`."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.functions.scalars import _unescape
from cellmend.operators.ledger import parse_answer, salvage_object

# fixed value: scripts that a model reads at about one token a character
_WIDE = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"

#: functions of SQL alone, planned with the query that calls them
SCALARS = {
    "normalize_value(v STRING)": ("STRING", r"trim(regexp_replace(CASE WHEN v IS NULL THEN '' WHEN contains(v, '&') THEN unescape_html(v) ELSE v END, r'[\t\n ]+', ' '))"),
    "bounded_text(v STRING, n INT)": ("STRING", "CASE WHEN length(v) > n THEN concat(left(v, n - 1), '…') ELSE v END"),
    "value_type(v STRING)": ("STRING", r"""CASE WHEN v = '' THEN 'empty' WHEN v RLIKE r'^[+-]?(\p{Nd}+(\.\p{Nd}*)?|\.\p{Nd}+)$' THEN 'number'
      WHEN v RLIKE r'^(\p{Nd}{4}[-/]\p{Nd}{1,2}[-/]\p{Nd}{1,2}|\p{Nd}{1,2}[-/]\p{Nd}{1,2}[-/]\p{Nd}{2,4})$' THEN 'date' WHEN v RLIKE r'(?i)^\p{Nd}{1,2}:\p{Nd}{2}(:\p{Nd}{2})?([\s\p{Z}]*[ap]\.?m\.?)?$' THEN 'time'
      WHEN v RLIKE r'^[^\s\p{Z}@]+@[^\s\p{Z}@]+\.[^\s\p{Z}@]+$' THEN 'email' WHEN v RLIKE r'(?i)^(https?://|www\.)' THEN 'url' WHEN lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n') THEN 'boolean' ELSE 'text' END"""),
    "format_signature(v STRING)": ("STRING", r"""CASE WHEN v = '' THEN 'EMPTY' ELSE left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(left(v, 80), r'\p{L}', 'A'), r'[\p{Nd}²³¹]', '9'), r'[\s\p{Z}\x1c-\x1f\x85]', '_'), r'(?s)(.)\1+', '$1'), 40) END"""),
    "token_estimate(v STRING)": ("BIGINT", f"greatest(1, length(v) - length(regexp_replace(v, r'{_WIDE}', '')) + CAST(ceil(octet_length(regexp_replace(v, r'{_WIDE}', '')) / 4) AS BIGINT))"),
    "completion_ceiling(k INT)": ("BIGINT", "CASE WHEN k = 1 THEN 192 ELSE 64 + 192 * k END"),
    "row_cluster(cell STRING)": ("STRING", r"regexp_extract(cell, r'^(.*:\d+):\d+$', 1)"),
    "support_bucket(x DOUBLE)": ("STRING", "CASE WHEN x = 0 THEN 'zero' WHEN abs(x) < 0.25 THEN 'low' WHEN abs(x) < 0.75 THEN 'medium' WHEN abs(x) <= 1 THEN 'high' ELSE concat('count_', least(8, floor(log2(abs(x) + 1)))) END"),
    "canonical_digest(v STRING)": ("STRING", r"regexp_replace(lower(regexp_replace(v, r'^\s+|\s+$', '')), r'^(?:[a-z][a-z0-9-]*:|0x)\s*', '')"),
}


@F.pandas_udf(T.StringType())
def salvage_json(texts: pd.Series) -> pd.Series:
    """The first JSON object in each text, in one line, null where there is none."""

    def of(text: str) -> str | None:
        found = salvage_object(text)
        return None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True)

    return texts.map(of, na_action="ignore")


class HalfStrideWindows:
    """(start, members): windows of k over an ordered array, half a window apart, the last one at the very end."""

    def eval(self, ordered: list[str], k: int) -> Iterator[tuple[int, list[str]]]:
        n = len(ordered or [])
        if k and 0 < k <= n:
            for start in sorted({*range(0, n - k + 1, max(1, k // 2)), n - k}):
                yield start, ordered[start : start + k]


class ParsedRepairs:
    """(cell_id, repair, confidence, decision, evidence, parse_status): the valid items of an answer; none gives one row with its status."""

    def eval(self, text: str, query_id: str, cells: list[str]) -> Iterator[tuple]:
        out = parse_answer(text, query_id, list(cells or []))
        for i in out["items"]:
            yield i["cell_id"], i["repair"], i["confidence"], i["decision"], i["evidence"], out["parse_status"]
        if not out["items"]:
            yield None, None, None, None, None, out["parse_status"]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; gives their names."""
    spark.udf.register("unescape_html", _unescape)
    spark.udf.register("salvage_json", salvage_json)
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("half_stride_windows", F.udtf(HalfStrideWindows, returnType="start: int, members: array<string>"))
    spark.udtf.register("parse_repairs", F.udtf(ParsedRepairs, returnType="cell_id: string, repair: string, confidence: double, decision: string, evidence: string, parse_status: string"))
    return [*(h.split("(")[0] for h in SCALARS), "unescape_html", "salvage_json", "half_stride_windows", "parse_repairs"]
