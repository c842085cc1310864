"""The catalogue of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: White space of any kind, for RE2.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_normal_form(x: str) -> str:
    """The normal form of a text in the oracle's SQL."""
    return f"nullif(lower(regexp_replace(regexp_replace(nfc_normalize({x}), '^{_SPACE}', ''), '{_SPACE}$', '')), '')"


def register(name: str, query: Query, sql: str | None = None) -> Query:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql
    return query


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""
    return lambda f: register(f.__name__, f, sql)
