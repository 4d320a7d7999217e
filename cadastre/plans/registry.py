"""Registry of queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(c: str | Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(f"`{c}`", digits) for c in columns})


def s6(expression: str, name: str | None = None, digits: int = 6) -> str:
    """The same rounding in SQL."""
    text = f"(round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"
    return f"{text} AS {name}" if name else text
