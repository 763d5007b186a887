"""Registered queries: each has a Spark plan and, where SQL can say it, the same result as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; adding 0 turns a negative zero into zero."""
    names = cols or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in names})
