"""Registering of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Terms of a column `text`, as functions.text.terms() has them.
TERMS = r"""flatten(list_transform(list_filter(string_split_regex(regexp_replace(text, '([\p{Han}\p{Hiragana}\p{Katakana}]+)', ' \1 ', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> ''),
    lambda x: case when regexp_matches(x, '^[\p{Han}\p{Hiragana}\p{Katakana}]{2}') then list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) else [x] end))"""


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables as query `name`, with DuckDB SQL over the views where SQL can express it."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add
