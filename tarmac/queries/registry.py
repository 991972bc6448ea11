"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def on_flights(sql: str, more: str = "") -> str:
    return f"WITH {X.FLIGHTS_SQL}{more} {sql}"


def on_flights_utc(sql: str, more: str = "") -> str:
    return f"WITH {X.FLIGHTS_UTC_SQL}{more} {sql}"


def on_scored(sql: str, more: str = "") -> str:
    return f"WITH {X.SCORED_SQL}{more} {sql}"


def on_events(sql: str, more: str = "") -> str:
    return f"WITH {X.EVENTS_SQL}{more} {sql}"


def rounded(c, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def round_columns(df: DataFrame, names, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
