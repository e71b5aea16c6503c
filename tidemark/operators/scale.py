"""Scaler fitting, applying and inverting; column profiles.

A scaler is a table with one row per feature: `pos, feature, kind, center, scale, var, n`. Applying it fetches those few
rows once and puts them in the plan as constants, so no row of the data is joined or moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import SPAN, exact_quantiles, framed
from tidemark.operators.windows import melt_channels


def _table(wide: DataFrame, features: Sequence[str], kind: str, fields: dict[str, str]) -> DataFrame:
    """Turn one wide row of statistics named `<feature>|<stat>` into the scaler table."""
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(f).alias("feature"),
            F.lit(kind).alias("kind"),
            *[F.col(f"`{f}|{stat}`").alias(name) if stat else F.lit(None).cast("double").alias(name) for name, stat in fields.items()],
        )
        for i, f in enumerate(features)
    ])
    out = wide.select(F.inline(rows))
    safe = F.when((F.col("scale") == 0) | F.col("scale").isNull() | F.isnan("scale"), F.lit(1.0)).otherwise(F.col("scale"))
    return out.withColumn("scale", safe).withColumns({c: F.lit(None).cast("double") for c in ("q_low", "q_high")})


def standard_fit(rows: DataFrame, features: Sequence[str], sample: bool = False) -> DataFrame:
    """Mean and population std (sample std with `sample`); a std of 0 becomes 1."""
    std, var = (F.stddev_samp, F.var_samp) if sample else (F.stddev_pop, F.var_pop)
    wide = rows.agg(
        *[F.avg(f).alias(f"{f}|m") for f in features],
        *[std(f).alias(f"{f}|s") for f in features],
        *[var(f).alias(f"{f}|v") for f in features],
        *[F.count(f).alias(f"{f}|n") for f in features],
    )
    return _table(wide, features, "standard", {"center": "m", "scale": "s", "var": "v", "n": "n"})


def minmax_fit(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Minimum and range; a range of 0 becomes 1."""
    wide = rows.agg(
        *[F.min(f).cast("double").alias(f"{f}|m") for f in features],
        *[(F.max(f) - F.min(f)).cast("double").alias(f"{f}|s") for f in features],
        *[F.count(f).alias(f"{f}|n") for f in features],
    )
    return _table(wide, features, "minmax", {"center": "m", "scale": "s", "var": "", "n": "n"})


def robust_fit(rows: DataFrame, features: Sequence[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Median and exact inter-quantile range; a range of 0 becomes 1."""
    q = exact_quantiles(melt_channels(rows, [], features, "v"), ["channel"], "v", [low, 0.5, high])
    at = lambda p: F.max(F.when(F.col("p") == float(p), F.col("q")))
    wide = q.groupBy("channel").agg(at(0.5).alias("center"), (at(high) - at(low)).alias("scale"), F.max("n").alias("n"))
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("channel")).cast("int") - 1
    safe = F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale"))
    return wide.select(
        place.alias("pos"),
        F.col("channel").alias("feature"),
        F.lit("robust").alias("kind"),
        "center",
        safe.alias("scale"),
        F.lit(None).cast("double").alias("var"),
        "n",
        F.lit(float(low)).alias("q_low"),
        F.lit(float(high)).alias("q_high"),
    )


def fit_named(rows: DataFrame, features: Sequence[str], name: str) -> DataFrame | None:
    """Fit by configured name: `StandardScaler`, `MinMaxScaler`, `RobustScaler` or `RobustScaler-q1-q2`; None for ''."""
    if not name:
        return None
    kind, *qs = name.split("-")
    if kind == "RobustScaler":
        low, high = (float(qs[0]), float(qs[1])) if len(qs) == 2 else (0.25, 0.75)
        if low > 1 or high > 1:
            low, high = low / 100, high / 100
        return robust_fit(rows, features, low, high)
    if kind == "StandardScaler":
        return standard_fit(rows, features)
    if kind == "MinMaxScaler":
        return minmax_fit(rows, features)
    raise ValueError(f"unknown scaler {name!r}")


def scaler_params(scaler: DataFrame, features: Sequence[str]) -> dict[str, Column]:
    """Constants `c<i>` (center) and `s<i>` (scale); the scaler's features and their order must equal `features`."""
    rows = sorted(scaler.select("pos", "feature", "center", "scale").collect())  # one row per feature
    if [row["feature"] for row in rows] != list(features):
        raise ValueError(f"scaler features {[row['feature'] for row in rows]} differ from {list(features)}")
    constant = lambda x: F.lit(x).cast("double")
    return {f"{c[0]}{i}": constant(row[c]) for i, row in enumerate(rows) for c in ("center", "scale")}


def scale_apply(df: DataFrame, scaler: DataFrame | None, features: Sequence[str]) -> DataFrame:
    """`(x - center) / scale` on plain columns; other columns, such as labels, stay. No scaler: unchanged."""
    if scaler is None:
        return df
    p = scaler_params(scaler, features)
    return df.withColumns({f: (F.col(f) - p[f"c{i}"]) / p[f"s{i}"] for i, f in enumerate(features)})


def scale_inverse(df: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    """`x * scale + center` on plain columns."""
    p = scaler_params(scaler, features)
    return df.withColumns({f: F.col(f) * p[f"s{i}"] + p[f"c{i}"] for i, f in enumerate(features)})


def scale_windows(windows: DataFrame, scaler: DataFrame, features: Sequence[str], inverse: bool = False) -> DataFrame:
    """The same on channel arrays."""
    p = scaler_params(scaler, features)

    def change(i: int):
        c, s = p[f"c{i}"], p[f"s{i}"]
        return (lambda x: x * s + c) if inverse else (lambda x: (x - c) / s)

    return windows.withColumns({f: F.transform(f, change(i)) for i, f in enumerate(features)})


def fit_on_windows_rows(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str], length: int, start: Column, idx: str = "idx", span: int = SPAN
) -> DataFrame:
    """Standard fit on the distinct rows covered by the windows at `start`."""
    marked = rows.select(*keys, idx, *features, start.cast("int").alias("_s"))
    covered = framed(marked, keys, idx, {"_in": (F.max("_s"), 1 - length, 0)}, span).where("_in = 1")
    return standard_fit(covered, features)


def fit_on_windows(
    rows: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    length: int,
    start: Column,
    idx: str = "idx",
    n: str = "n",
    span: int = SPAN,
) -> DataFrame:
    """Per-channel mean and population std over all values of all complete windows, overlaps counted repeatedly.

    A row counts once per window that covers it, so no window is built.
    """
    complete = (start & (F.col(idx) <= F.col(n) - length)).cast("int")
    marked = rows.select(*keys, idx, *features, complete.alias("_s"))
    weighted = framed(marked, keys, idx, {"_w": (F.sum("_s"), 1 - length, 0)}, span).where("_w > 0")
    w = F.col("_w").cast("double")
    found = weighted.agg(*[F.try_divide(F.sum(w * F.col(f)), F.sum(w)).alias(f) for f in features]).first()
    means = {f: F.lit(found[f]).cast("double") for f in features}
    wide = weighted.agg(
        *[F.max(means[f]).alias(f"{f}|m") for f in features],
        *[F.sqrt(F.try_divide(F.sum(w * F.pow(F.col(f) - means[f], 2)), F.sum(w))).alias(f"{f}|s") for f in features],
        *[F.try_divide(F.sum(w * F.pow(F.col(f) - means[f], 2)), F.sum(w)).alias(f"{f}|v") for f in features],
        *[F.sum("_w").alias(f"{f}|n") for f in features],
    )
    return _table(wide, features, "standard", {"center": "m", "scale": "s", "var": "v", "n": "n"})


def profile_features(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample std, min and max: one row per (keys, feature)."""
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.groupBy(*keys).agg(*[fn(f).alias(f"{f}|{s}") for f in features for s, fn in stats.items()])
    rows = F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            *[F.col(f"`{f}|{s}`").cast("long" if s == "count" else "double").alias(s) for s in stats],
        )
        for f in features
    ])
    return wide.select(*keys, F.inline(rows))
