"""A register of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def digest_sql(value: str) -> str:
    """What operators.deliveries.canonical_digest makes of a value."""
    return rf"regexp_replace(lower(regexp_replace({value}, '^\s+|\s+$', '', 'g')), '^(?:[a-z][a-z0-9-]*:|0x)\s*', '')"


def register() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str], Callable]:
    """(queries, SQL, decorator that adds to both). In SQL, @name stands for the digest in the column of that name."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    texts: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                texts[f.__name__] = re.sub(r"@(\w+)", lambda m: digest_sql(m[1]), sql)
            return f

        return add

    return queries, texts, query
