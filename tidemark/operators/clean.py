"""Projections, filters and predicates on telemetry rows and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ordered import SPAN, Running, bucket_by_index, running


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order, without `exclude`."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def project_features(
    df: DataFrame,
    features: Sequence[str] | None = None,
    targets: Sequence[str] | None = None,
    remove: Sequence[str] = (),
    label: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Keys, then features, then targets not already among them, then the label if present.

    `features=None` takes every column; `targets=None` means the targets are the features.
    """
    base = [c for c in df.columns if c not in keys and c != label] if features is None else list(features)
    wanted = [c for c in [*base, *(targets or [])] if c not in remove]
    if label and label in df.columns:
        wanted.append(label)
    return df.select(*dict.fromkeys([*keys, *wanted]))


def remove_target(df: DataFrame, targets: Sequence[str] = (), labels: Sequence[str] = ()) -> DataFrame:
    """Model input: without target and label columns."""
    return df.drop(*targets, *labels)


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with NULL or NaN in any of `cols` (all columns by default)."""
    return df.dropna(subset=list(cols) if cols else None)


def head_rows(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """The first `n` positions of each series."""
    return df.where(F.col(idx) < n)


def time_slice(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """Rows between two times, both ends kept."""
    return df.where(F.col(ts).between(start, end))


def time_slice_from(
    df: DataFrame, offset: int, length_us: int, keys: Sequence[str], idx: str = "idx", us: str = "us", span: int = SPAN
) -> DataFrame:
    """Rows of each series from position `offset` on, for `length_us` microseconds (both ends kept)."""
    out = running(
        bucket_by_index(df, idx, span), keys, [F.col(idx)], {}, {"_start": ("min", F.when(F.col(idx) == offset, F.col(us)))}
    )
    return out.where(F.col(us).between(F.col("_start"), F.col("_start") + F.lit(length_us))).drop("_start")


def calendar_split(df: DataFrame, cutoff: Column, ts: str = "ts", name: str = "part") -> DataFrame:
    """`trainval` before the cutoff, `test` from it on."""
    return df.withColumn(name, F.when(F.col(ts) < cutoff, "trainval").otherwise("test"))


def rule_labels(df: DataFrame, rules: dict[str, Column], any_name: str = "irregular") -> DataFrame:
    """One 0/1 flag per rule, and `any_name` = 1 when any flag is set."""
    out = df.withColumns({n: F.when(c, 1).otherwise(0) for n, c in rules.items()})
    flags = [F.col(n) for n in rules]
    return out.withColumn(any_name, F.greatest(*flags) if len(flags) > 1 else flags[0])


def mask_around_events(
    df: DataFrame,
    keys: Sequence[str],
    flags: Sequence[str],
    within_us: int,
    cols: Sequence[str],
    idx: str = "idx",
    us: str = "us",
    span: int = SPAN,
) -> DataFrame:
    """Blank `cols` on rows strictly closer than `within_us` to a row of the series where any flag is 1.

    Needs only the nearest flagged time on either side, a running max and a backward running min.
    """
    flagged = F.greatest(*[F.col(f) for f in flags]) if len(flags) > 1 else F.col(flags[0])
    hit = F.when(flagged == 1, F.col(us))
    near = running(
        bucket_by_index(df, idx, span),
        keys,
        [F.col(idx)],
        {"_last": Running("max", hit), "_next": Running("min", hit, backward=True)},
    )
    close = F.coalesce(F.col(us) - F.col("_last") < within_us, F.lit(False)) | F.coalesce(
        F.col("_next") - F.col(us) < within_us, F.lit(False)
    )
    masked = near.withColumn("masked", close.cast("int")).withColumns(
        {c: F.when(F.col("masked") == 0, F.col(c)) for c in cols}
    )
    return masked.drop("_last", "_next")


def any_channel_over(errors: dict[str, Column], thresholds: dict[str, Column]) -> Column:
    """1 when any channel's error exceeds its own threshold. An error or threshold that is null or not a number exceeds nothing."""
    known = lambda x: x.isNotNull() & ~F.isnan(x)
    over = [F.coalesce(known(errors[c]) & known(thresholds[c]) & (errors[c] > thresholds[c]), F.lit(False)) for c in errors]
    flag = over[0]
    for o in over[1:]:
        flag = flag | o
    return flag.cast("int")


def has_anomaly(labels: Column | str) -> Column:
    """True when a window's label array contains a 1."""
    return F.exists(F.col(labels) if isinstance(labels, str) else labels, lambda x: x == 1)


def filter_windows_by_label(df: DataFrame, labels: str = "labels", anomalous: bool = True) -> DataFrame:
    """Anomalous windows (any label 1), or the others."""
    hit = F.coalesce(has_anomaly(labels), F.lit(False))
    return df.where(hit if anomalous else ~hit)


def guard_non_finite(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Counts of NULL, NaN and infinite values: one row per (keys, column)."""
    wide = df.groupBy(*keys).agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}|nulls") for c in cols],
        *[F.count_if(F.isnan(c)).alias(f"{c}|nans") for c in cols],
        *[F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"{c}|infs") for c in cols],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            *[F.col(f"`{c}|{k}`").alias(k) for k in ("nulls", "nans", "infs")],
        )
        for c in cols
    ])
    return wide.select(*keys, F.inline(rows))


def assert_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same rows; the job fails on the first NaN or infinite value in `cols`."""
    def checked(c: str) -> Column:
        bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"non-finite value in {c}")).cast("double")).otherwise(F.col(c))

    return df.withColumns({c: checked(c) for c in cols})
