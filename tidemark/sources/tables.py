"""Telemetry readers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scan_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Read by file extension: parquet, otherwise csv with a header. Give csv a schema; without one it is inferred."""
    if path.rstrip("/").lower().endswith((".parquet", ".pq")):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def scan_multi_join(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """One wide table from one table per quantity (and a label table) on the same series and time."""
    return reduce(lambda a, b: a.join(b, list(on), "inner"), tables)
