"""Small helpers that several operators of this package share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH = 2 << 20  # bytes of an Arrow batch, about
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """`mapInArrow` by batches of about `BATCH` bytes. By Spark's default, a batch holds a whole partition of texts or sets, of which a task
    has several copies outside the heap. The size is a setting of the session, which keeps it; one that is not the default is left as it is.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, str(BATCH))
    return df.mapInArrow(run, schema)


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast path: there, full lower-casing is the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_share(df: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, share: int = 1000, inner: bool = False) -> DataFrame:
    """Left join of `df` with `right`, whose rows are unique by `keys` and say in `weight` how many rows of `df` meet them.

    Keys that hold at least one in `share` of `total` rows are joined by broadcast, so no task receives a hot key. There are
    `share` such keys at most, whatever the size of the data, as their weights add up to `total` at most. The other keys are
    joined by shuffle. With `inner`, rows of `df` that meet none go. Neither side may have null keys.
    """
    floor = max(1, math.ceil(total / share))
    values = [c for c in right.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in values])
    hot = right.where(F.col(weight) >= floor).select(*keys, packed.alias("__hot"))
    cold = right.where(F.col(weight) < floor).select(*keys, packed.alias("__cold"))
    if inner:
        met = df.join(F.broadcast(hot), keys).select(*df.columns, F.col("__hot").alias("__v"))
        rest = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys).select(*df.columns, F.col("__cold").alias("__v"))
        return met.unionByName(rest).select(*df.columns, *[F.col("__v")[c].alias(c) for c in values])
    left = df.join(F.broadcast(hot), keys, "left")
    met = left.where(F.col("__hot").isNotNull()).select(*df.columns, F.col("__hot").alias("__v"))
    rest = left.where(F.col("__hot").isNull()).drop("__hot").join(cold, keys, "left").select(*df.columns, F.col("__cold").alias("__v"))
    return met.unionByName(rest).select(*df.columns, *[F.col("__v")[c].alias(c) for c in values])
