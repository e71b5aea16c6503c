"""Upsampling, label propagation, augmentation and regular grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions.ordered import SPAN, Running, framed, null_safe, running, spread_join, with_halo
from tidemark.operators.windows import time_grid

METHODS = ("linear", "nearest", "previous", "next", "cubic", "cubic_local")
STEPS = 6  # off-diagonals of 1/2 squared so often are below the resolution of a double
REACH = (1 << STEPS) + 4  # rows on each side that a curvature can depend on


def _with_ends(df: DataFrame, keys: Sequence[str], axis: str, idx: str, span: int) -> DataFrame:
    ends = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(axis).cast("double").alias("_x0"), F.max(axis).cast("double").alias("_xn")
    )
    return spread_join(df, ends, keys, idx, span)


def upsample_grid(df: DataFrame, keys: Sequence[str], factor: int, axis: str = "us", idx: str = "idx", span: int = SPAN) -> DataFrame:
    """`(n - 1) * factor + 1` equally spaced points `(g, x)` from the first to the last time of each series.

    Each input row yields its own `factor` grid numbers, so the grid is as evenly spread as the rows.
    """
    rows = _with_ends(df.select(*keys, idx, axis), keys, axis, idx, span)
    return _grid_points(rows, keys, factor, idx)


def _grid_points(rows: DataFrame, keys: Sequence[str], factor: int, idx: str, carry: Sequence[str] = ()) -> DataFrame:
    last = F.when(F.col(idx) < F.col("_n") - 1, F.lit(factor - 1)).otherwise(F.lit(0))
    points = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), last)))
    g = (F.col(idx) * factor + F.col("_j")).cast("long")
    steps = F.greatest((F.col("_n") - 1) * factor, F.lit(1)).cast("double")
    x = F.col("_x0") + g.cast("double") * (F.col("_xn") - F.col("_x0")) / steps
    return points.select(*keys, g.alias("g"), x.alias("x"), *carry)


def _cubic(points: Sequence[tuple[Column, Column]], x: Column) -> Column:
    """Value at x of the cubic through four points."""
    total = None
    for i, (xi, yi) in enumerate(points):
        term = yi
        for j, (xj, _) in enumerate(points):
            if j != i:
                term = F.try_divide(term * (x - xj), xi - xj)
        total = term if total is None else total + term
    return total


def _spline_curvatures(rows: DataFrame, window: WindowSpec, channels: Sequence[str], idx: str) -> DataFrame:
    """Add `_m_<channel>`: second derivative at each sample of the cubic spline with not-a-knot ends.

    `rows` has `_x`, position `idx` and length `_n`; `window` is one bucket in order. The curvatures solve a tridiagonal system whose
    rows, scaled to a diagonal of one, have off-diagonals of 1/2 together. One step of cyclic reduction couples each row with rows
    twice as far away and squares that number, so after `STEPS` steps nothing is left but the diagonal. A bucket with `REACH` rows of
    its neighbours is therefore solved on its own.
    """
    i, last = F.col(idx), F.col("_n") - 1
    before, h = F.col("_x") - F.lag("_x").over(window), F.lead("_x").over(window) - F.col("_x")
    out = rows.select("*", before.alias("_hb"), h.alias("_h"), *[(F.col(c) - F.lag(c).over(window)).alias(f"_db_{c}") for c in channels], *[(F.lead(c).over(window) - F.col(c)).alias(f"_d_{c}") for c in channels])
    hb, h = F.col("_hb"), F.col("_h")
    inner = (i > 0) & (i < last) & hb.isNotNull() & h.isNotNull()
    first, final = i == 1, i == last - 1
    sides = {
        "_a": F.when(first, 0.0).when(final, (hb - h) / (2 * hb + h)).otherwise(hb / (2 * (hb + h))),
        "_c": F.when(final, 0.0).when(first, (h - hb) / (2 * h + hb)).otherwise(h / (2 * (hb + h))),
    }
    weight = F.when(first, h / ((hb + h) * (2 * h + hb))).when(final, hb / ((hb + h) * (2 * hb + h))).otherwise(1 / (2 * (hb + h)))
    bends = {f"_m_{c}": 6 * (F.col(f"_d_{c}") / h - F.col(f"_db_{c}") / hb) * weight for c in channels}
    out = out.withColumns({n: F.when(inner, v).otherwise(0.0) for n, v in (sides | bends).items()})
    out = out.drop(*[f"_d{k}_{c}" for k in ("", "b") for c in channels])
    values = ["_a", "_c", *bends]
    for k in range(STEPS):
        near = out.select("*", *[f(v, 1 << k, 0.0).over(window).alias(f"{v}{side}") for v in values for f, side in ((F.lag, "<"), (F.lead, ">"))])
        a, c = F.col("_a"), F.col("_c")
        rest = 1 - a * F.col("`_c<`") - c * F.col("`_a>`")
        step = {"_a": -a * F.col("`_a<`") / rest, "_c": -c * F.col("`_c>`") / rest}
        step |= {m: (F.col(m) - a * F.col(f"`{m}<`") - c * F.col(f"`{m}>`")) / rest for m in bends}
        out = near.select(*[F.col(x) for x in out.columns if x not in values], *[v.alias(n) for n, v in step.items()])

    def ends(m: str) -> Column:
        """Not-a-knot: the third derivative does not change at the second and the last but one sample."""
        to = lambda f, n: f(m, n).over(window)
        low = to(F.lead, 1) - h / F.lead("_h").over(window) * (to(F.lead, 2) - to(F.lead, 1))
        high = to(F.lag, 1) + hb / F.lag("_hb").over(window) * (to(F.lag, 1) - to(F.lag, 2))
        return F.when(i == 0, low).when(i == last, high).otherwise(F.col(m))

    return out.select(*[F.col(x) for x in out.columns if x not in bends], *[ends(m).alias(m) for m in bends]).drop("_a", "_c", "_h", "_hb")


def _last_of_each_time(df: DataFrame, keys: Sequence[str], axis: str, idx: str, span: int) -> DataFrame:
    """Of several rows at one time the last one, with dense positions again."""
    seen = framed(df, keys, idx, {"_next": (F.max(axis), 1, 1)}, span, keep_bucket=True)
    kept = seen.where(F.col("_next").isNull() | (F.col("_next") != F.col(axis))).drop("_next")
    return running(kept, keys, [F.col(idx)], {"_i": Running("count", F.lit(1), exclusive=True)}).withColumn(idx, F.col("_i").cast("long")).drop("_i")


def upsample(
    df: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    factor: int,
    method: str = "linear",
    axis: str = "us",
    idx: str = "idx",
    span: int = SPAN,
) -> DataFrame:
    """Channels interpolated on the upsampled grid: `keys, g, x, channels`. `idx` is the dense position of a sample in its series.

    linear extends the first and last segment beyond the samples. nearest/previous/next take a neighbour (a point half way takes the
    earlier one). cubic is the spline through all samples of the series with not-a-knot ends; series with fewer than four different
    times are linear, and a null value makes the points around it null. cubic_local is the cubic through two samples on each side,
    linear in the first and last interval. Of several samples at one time the last counts. A null key is a key.

    Rows move once, in buckets of positions. Each sample then gives the grid points up to the next sample by arithmetic; an interval of
    very many points is dealt out in pieces.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if factor <= 1:
        return df
    back, ahead = {"cubic": (REACH, REACH), "cubic_local": (1, 2)}.get(method, (1, 1))
    base = df.select(*dict.fromkeys([*keys, idx, axis, *channels]))
    counted = base.groupBy(null_safe(keys).alias("_k")).agg(F.count(F.lit(1)).alias("_all"))
    if method == "cubic":
        base = _last_of_each_time(base, keys, axis, idx, span)
    base = base.select(*keys, idx, F.col(axis).cast("double").alias("_x"), *[F.col(c).cast("double").alias(c) for c in channels], null_safe(keys).alias("_k"))
    placed = with_halo(base, idx, back, ahead, span).repartition("_k", "_b")
    part = placed.where("_own").groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("x0"), F.max("_x").alias("xn"))
    ends = part.groupBy("_k").agg(F.sum("n").alias("_n"), F.min("x0").alias("_x0"), F.max("xn").alias("_xn"))
    # the grid has its points by all samples, also those of one time
    ends = ends.join(counted, "_k") if method == "cubic" else ends.withColumn("_all", F.col("_n"))
    # a bucket has rows of its own in it or lies beside one that has, so every bucket meets the ends of its series
    beside = part.select("_k", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b")).distinct()
    rows = placed.join(beside.join(ends, "_k"), ["_k", "_b"])
    window = Window.partitionBy("_k", "_b").orderBy(idx)
    if method == "cubic":
        rows = _spline_curvatures(rows, window, channels, idx)
    carried = ["_x", *channels, *([f"_m_{c}" for c in channels] if method == "cubic" else [])]
    item = F.struct(*[F.col(c) for c in carried])
    around = rows.select("*", F.lag(item).over(window).alias("_km1"), F.lead(item).over(window).alias("_k1"), F.lead(item, 2).over(window).alias("_k2"))
    samples = around.where("_own").select(*keys, F.col("_x").alias("_at"), "_n", "_all", "_x0", "_xn", item.alias("_k0"), "_km1", "_k1", "_k2")
    steps = (F.greatest(F.col("_all") - 1, F.lit(0)) * factor).cast("long")
    wide = F.greatest(steps, F.lit(1)).cast("double")
    width, after = F.col("_xn") - F.col("_x0"), F.col("_k1._x")
    near = lambda x: F.try_divide((x - F.col("_x0")) * wide, width)
    low = F.greatest(F.lit(0), F.coalesce(F.floor(near(F.col("_at"))).cast("long"), F.lit(0)) - 1)
    high = F.least(steps, F.coalesce(F.ceil(near(after)).cast("long") + 1, steps))
    pieces = samples.withColumn("_low", F.when(F.col("_km1").isNull(), 0).otherwise(low).cast("long")).withColumn("_high", high)
    pieces = pieces.where("_low <= _high").withColumn("_low", F.explode(F.sequence("_low", "_high", F.lit(SPAN).cast("long"))))
    dealt = pieces.repartition(*keys, "_low")
    points = dealt.withColumn("g", F.explode(F.sequence("_low", F.least(F.col("_high"), F.col("_low") + (SPAN - 1)))))
    points = points.withColumn("x", F.col("_x0") + F.col("g").cast("double") * width / wide)
    points = points.where((F.col("_km1").isNull() | (F.col("x") >= F.col("_at"))) & (after.isNull() | (F.col("x") < after)))
    x, here, before, nxt, second = F.col("x"), F.col("_k0"), F.col("_km1"), F.col("_k1"), F.col("_k2")

    def line(a: Column, b: Column, c: str) -> Column:
        return a[c] + F.try_divide((b[c] - a[c]) * (x - a["_x"]), b["_x"] - a["_x"])

    def arc(a: Column, b: Column, c: str) -> Column:
        h, left, right = b["_x"] - a["_x"], b["_x"] - x, x - a["_x"]
        bend = lambda k, t: k[f"_m_{c}"] * t / 6 * (t * t / h - h)
        return (a[c] * left + b[c] * right) / h + bend(a, left) + bend(b, right)

    def value(c: str) -> Column:
        if method == "previous":
            return here[c]
        if method == "next":
            return F.when((x == here["_x"]) | nxt.isNull(), here[c]).otherwise(nxt[c])
        if method == "nearest":
            return F.when(nxt.isNotNull() & (x - here["_x"] > nxt["_x"] - x), nxt[c]).otherwise(here[c])
        straight = F.when(nxt.isNotNull(), line(here, nxt, c)).when(before["_x"] < here["_x"], line(before, here, c)).otherwise(here[c])
        if method == "linear":
            return straight
        if method == "cubic":
            return F.when(F.col("_n") < 4, straight).when(nxt.isNotNull(), arc(here, nxt, c)).otherwise(arc(before, here, c))
        inside = (before["_x"] < here["_x"]) & (nxt["_x"] < second["_x"]) & (F.col("_n") >= 4)
        return F.when(inside, _cubic([(p["_x"], p[c]) for p in (before, here, nxt, second)], x)).otherwise(straight)

    return points.select(*keys, "g", "x", *[value(c).alias(c) for c in channels])


def propagate_labels(
    df: DataFrame, keys: Sequence[str], labels: Sequence[str], factor: int, mode: str = "forward", idx: str = "idx", n: str = "n"
) -> DataFrame:
    """Labels on the upsampled grid. forward: grid point g takes row `g div factor`; backward: one point later."""
    if mode not in ("forward", "backward"):
        raise ValueError(f"unknown mode {mode!r}")
    if factor <= 1:
        return df
    first = F.col(idx) * factor
    end = (F.col(n) - 1) * factor
    if mode == "forward":
        low, high = first, F.least(first + (factor - 1), end)
    else:
        low = F.when(F.col(idx) == 0, F.lit(0).cast("long")).otherwise(first + 1)
        high = F.least(first + factor, end)
    out = df.withColumn("g", F.explode(F.when(low <= high, F.sequence(low.cast("long"), high.cast("long")))))
    return out.select(*keys, "g", *[F.col(c).cast("int").alias(c) for c in labels])


def jitter_augment(
    fine: DataFrame,
    coarse: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    jitter_std: float = 0.001,
    scale_range: tuple[float, float] = (0.995, 1.005),
    seed: int = 42,
    g: str = "g",
    span: int = SPAN,
) -> DataFrame:
    """Each channel times one random factor per (series, channel) plus noise of `jitter_std` times its coarse std.

    A std of 0 or NULL counts as 1. All points are changed, as in the system this follows.
    """
    stats = coarse.groupBy(*keys).agg(*[F.stddev_pop(c).alias(f"_sd_{c}") for c in channels])
    rows = spread_join(fine, stats, keys, g, span)
    low, high = scale_range

    def noisy(c: str) -> Column:
        sd = F.when(F.coalesce(F.col(f"_sd_{c}"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"_sd_{c}"))
        factor = F.lit(low) + F.lit(high - low) * hashing.uniform(seed, f"scale.{c}", *keys)
        return F.col(c) * factor + F.lit(jitter_std) * sd * hashing.normal(seed, f"jitter.{c}", *keys, g)

    return rows.withColumns({c: noisy(c) for c in channels}).drop(*[f"_sd_{c}" for c in channels])


def regular_grid(
    df: DataFrame, keys: Sequence[str], channels: Sequence[str], period_us: int, us: str = "us"
) -> DataFrame:
    """One row per period from each series' first to last time; times without a row get NULL channels. A null key is a key."""
    grid = time_grid(df, keys, period_us, us, us).withColumn("_k", null_safe([*keys, us]))
    known = df.select(null_safe([*keys, us]).alias("_k"), *channels)
    return grid.join(known, "_k", "left").select(*keys, us, *channels)
