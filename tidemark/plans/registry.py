"""Registry of named queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under the operator id, with the DuckDB statement that must give the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded double for comparison; turns -0.0 into 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def joined(array: Column | str, scale: float = 100.0) -> Column:
    """A numeric array as text of integers `round(x * scale)`, for comparison."""
    a = F.col(array) if isinstance(array, str) else array
    return F.array_join(F.transform(a, lambda x: F.round(x.cast("double") * scale).cast("long").cast("string")), ",", "null")
