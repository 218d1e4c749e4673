"""Scalar expressions on cell values. All but HTML unescaping stay inside the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def unescape_html(value: Column) -> Column:
    """HTML entities resolved; only values with an ampersand travel to Python."""
    has = value.contains("&")
    return F.when(has, _unescape(F.when(has, value))).otherwise(value)


def collapse_blanks(value: Column) -> Column:
    """Runs of tab, line feed and space become one space, outer ones go; carriage return and no-break space stay."""
    return F.trim(F.regexp_replace(value, "[\t\n ]+", " "))


def normalize_value(value: Column) -> Column:
    """Null becomes the empty text, then entities are resolved first and blanks collapsed after."""
    return collapse_blanks(unescape_html(F.coalesce(value, F.lit(""))))


def bounded(value: Column, limit: int = 160) -> Column:
    """Texts beyond the limit keep limit - 1 characters and an ellipsis."""
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit - 1)), F.lit("…"))).otherwise(value)


def value_type(text: Column) -> Column:
    """The coarse type of a normalised value, in a fixed order of tests."""
    return (
        F.when(text == "", "empty")
        .when(text.rlike(r"^[+-]?(\p{Nd}+(\.\p{Nd}*)?|\.\p{Nd}+)$"), "number")
        .when(text.rlike(r"^(\p{Nd}{4}[-/]\p{Nd}{1,2}[-/]\p{Nd}{1,2}|\p{Nd}{1,2}[-/]\p{Nd}{1,2}[-/]\p{Nd}{2,4})$"), "date")
        .when(text.rlike(r"(?i)^\p{Nd}{1,2}:\p{Nd}{2}(:\p{Nd}{2})?([\s\p{Z}]*[ap]\.?m\.?)?$"), "time")
        .when(text.rlike(r"^[^\s\p{Z}@]+@[^\s\p{Z}@]+\.[^\s\p{Z}@]+$"), "email")
        .when(text.rlike(r"(?i)^(https?://|www\.)"), "url")
        .when(F.lower(text).isin("true", "false", "yes", "no", "y", "n"), "boolean")
        .otherwise("text")
    )


def format_signature(text: Column) -> Column:
    """The shape of a normalised value: letters A, digits 9, blanks _, runs of one character once, 40 at most of the first 80."""
    s = F.regexp_replace(F.left(text, F.lit(80)), r"\p{L}", "A")
    s = F.regexp_replace(F.regexp_replace(s, r"[\p{Nd}²³¹]", "9"), r"[\s\p{Z}\x1c-\x1f\x85]", "_")
    return F.when(text == "", "EMPTY").otherwise(F.left(F.regexp_replace(s, r"(?s)(.)\1+", "$1"), F.lit(40)))


def support_bucket(x: Column) -> Column:
    size = F.abs(x)
    count = F.concat(F.lit("count_"), F.least(F.lit(8), F.floor(F.log2(size + 1))).cast("string"))
    return F.when(size == 0, "zero").when(size < 0.25, "low").when(size < 0.75, "medium").when(size <= 1, "high").otherwise(count)


# fixed value: scripts that a model reads at about one token a character
_WIDE = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"


def token_estimate(text: Column) -> Column:
    """Characters of East Asian scripts, and a quarter of the bytes of the rest, rounded up; 1 at least."""
    rest = F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(text, _WIDE, ""))  # nothing to look for in ASCII
    return F.greatest(F.lit(1), (F.length(text) - F.length(rest)) + F.ceil(F.octet_length(rest) / 4)).cast("long")


def completion_ceiling(k: Column) -> Column:
    return F.when(k == 1, 192).otherwise(64 + 192 * k).cast("long")


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def cell_id(suite: Column, dataset: Column, row: Column, col: Column) -> Column:
    return F.concat_ws(":", suite, dataset, row.cast("string"), col.cast("string"))


def row_cluster(cell: Column) -> Column:
    """The row that a cell id names: all before the last colon."""
    return F.regexp_extract(cell, r"^(.*:\d+):\d+$", 1)


def plain_text(text: Column) -> Column:
    """The lower-cased text with single blanks, whose n-grams are taken."""
    return F.lower(collapse_blanks(text))


def char_ngrams(text: Column, low: int = 2, high: int = 5) -> Column:
    """All n-grams of the lower-cased text with single blanks, as one array."""

    def of(t: Column, n: int) -> Column:
        starts = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(t, i, F.lit(n)))

    # a variable of one value: the text is lower-cased once, not for every n-gram
    return F.flatten(F.transform(F.array(plain_text(text)), lambda t: F.flatten(F.array(*(of(t, n) for n in range(low, high + 1))))))


def price_period(at: Column) -> Column:
    """peak on weekdays from 1 to 4 and from 6 to 10 o'clock UTC, off_peak else."""
    # fixed values: the hours of the price list
    return F.when((F.weekday(at) < 5) & (F.hour(at).between(1, 3) | F.hour(at).between(6, 9)), "peak").otherwise("off_peak")


def exact_units(value: Column, scale: int = 15) -> Column:
    """A gain as whole units of 10**-scale, half to even; the shortest decimal text of the double decides."""

    @F.pandas_udf("decimal(38,0)")
    def of(values: pd.Series) -> pd.Series:
        import decimal

        with decimal.localcontext() as c:
            c.prec = 400
            return values.map(lambda x: None if x is None or x != x else (decimal.Decimal(repr(float(x))) * 10**scale).quantize(decimal.Decimal(1), decimal.ROUND_HALF_EVEN))

    return of(value)
