"""Joins the telemetry steps need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import Running, bucket_by_value, running


def join_labels(data: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Data with labels on the same series and time."""
    return data.join(labels, list(on), "inner")


def join_pairs(corrupted: DataFrame, originals: DataFrame, origin: Sequence[str], prefix: str = "clean_") -> DataFrame:
    """Corrupted windows with their clean originals; the originals' other columns get `prefix`."""
    renamed = originals.select(*origin, *[F.col(c).alias(prefix + c) for c in originals.columns if c not in origin])
    return corrupted.join(renamed, list(origin), "inner")


def join_semi(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `a` at positions in `b`."""
    return a.join(b.select(*on).distinct(), list(on), "left_semi")


def join_anti(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `a` at positions not in `b`."""
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def _both_sides(left: DataFrame, right: DataFrame, keys: Sequence[str], axis: str, values: Sequence[str], back: bool) -> DataFrame:
    """Left and right rows in one table, in buckets of one order: `keys, axis, _l, _r, _tie, _b`.

    Right rows are the first of their time (the last, if not `back`); left rows of one time are told apart by a hash, so a time that
    many rows share is cut into several buckets. Of right rows with equal keys and time one stays: largest (smallest) values.
    """
    others = [c for c in left.columns if c not in (*keys, axis)]
    payload = F.struct(F.col(axis), *[F.col("_v")[c].alias(c) for c in values])
    pick = F.max if back else F.min
    one = right.where(F.col(axis).isNotNull()).groupBy(*keys, axis).agg(pick(F.struct(*values) if values else F.lit(0)).alias("_v"))
    ends = F.lit(-(2**63) if back else 2**63 - 1).cast("long")
    r_rows = one.select(*keys, axis, F.lit(None).alias("_l"), payload.alias("_r"), ends.alias("_tie"))
    packed = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    l_rows = left.select(*keys, axis, packed.alias("_l"))
    l_rows = l_rows.withColumns({"_r": F.lit(None).cast(r_rows.schema["_r"].dataType), "_tie": F.xxhash64(*[F.col(f"_l.{c}") for c in others]) if others else F.lit(0).cast("long")})
    merged = l_rows.unionByName(r_rows.withColumn("_l", F.lit(None).cast(l_rows.schema["_l"].dataType)))
    cuts = l_rows.select(axis, "_tie").unionByName(right.select(axis, ends.alias("_tie")))
    return bucket_by_value(merged, axis, "_tie", cuts_from=cuts)


def join_asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    axis: str,
    values: Sequence[str],
    direction: str = "backward",
    prefix: str = "at_",
) -> DataFrame:
    """Each left row with the nearest right row at or before it (`backward`) or at or after it (`forward`).

    Adds `<prefix><axis>` and `<prefix><value>`; left rows without a match get NULLs. Of several right rows at that time
    the one with the largest (`backward`) or smallest (`forward`) values counts. Both sides are merged into one
    order, so neither is gathered per key, and one time that many rows share is spread.
    """
    back = direction == "backward"
    others = [c for c in left.columns if c not in (*keys, axis)]
    near = running(
        _both_sides(left, right, keys, axis, values, back),
        keys,
        [F.col(axis), F.col("_tie")],
        {"_at": Running("max" if back else "min", F.col("_r"), backward=not back)},
    ).where(F.col("_l").isNotNull())
    return near.select(
        *keys, axis, *[F.col(f"_l.{c}").alias(c) for c in others],
        *[F.col(f"_at.{c}").alias(prefix + c) for c in (axis, *values)],
    )


def join_interval(rows: DataFrame, events: DataFrame, keys: Sequence[str], us: str, within_us: int) -> DataFrame:
    """Rows strictly closer than `within_us` to some event of the series, with the nearest event time on either side.

    Both sides come out of one order of rows and events; an event at the row's own time counts as both.
    """
    others = [c for c in rows.columns if c not in (*keys, us)]
    event = F.col(f"_r.{us}")
    near = running(
        _both_sides(rows, events, keys, us, [], True),
        keys,
        [F.col(us), F.col("_tie")],
        {f"before_{us}": Running("max", event), "_later": Running("min", event, backward=True)},
    ).where(F.col("_l").isNotNull())
    before = F.col(f"before_{us}")
    both = near.withColumn(f"after_{us}", F.when(before == F.col(us), before).otherwise(F.col("_later")))
    close = (F.col(us) - before < within_us) | (F.col(f"after_{us}") - F.col(us) < within_us)
    return both.where(close).select(*keys, us, *[F.col(f"_l.{c}").alias(c) for c in others], f"before_{us}", f"after_{us}")
