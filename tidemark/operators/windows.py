"""Fixed-length windows over ordered rows.

A window set is one row per window: keys, `start_idx`, one array column per channel, and optionally `labels`. Rows are packed in
blocks once and windows are slices of blocks, so rows move once whatever the overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import SPAN, Running, bucket_by_value, exact_quantiles, framed, null_safe, running, spread_join
from tidemark.sources.stage import stage


BLOCK = 512  # positions of a block that windows are cut from, or twice the window if that is more


def mark_starts(rows: DataFrame, starts: DataFrame, keys: Sequence[str], idx: str = "idx", name: str = "is_start") -> DataFrame:
    """Add a boolean column: the row is one of `starts` (keys, idx). A null key meets a null key."""
    marks = starts.select(null_safe([*keys, idx]).alias("_k")).distinct().withColumn("_mark", F.lit(True))
    met = rows.withColumn("_k", null_safe([*keys, idx])).join(marks, "_k", "left")
    return met.select(*[F.col(c) for c in rows.columns if c != name], F.coalesce("_mark", F.lit(False)).alias(name))


def slide_windows(
    rows: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    length: int,
    start: Column | None = None,
    label: str | None = None,
    idx: str = "idx",
    span: int = SPAN,
    carry: Sequence[str] = (),
    ahead: int = 0,
    target_channels: Sequence[str] | None = None,
    stride: int | None = None,
) -> DataFrame:
    """Windows `[s, s + length)` at rows where `start` holds; incomplete ones are dropped.

    Rows are packed in blocks of positions with the first rows of the next block; a window is a slice of a block. So rows are copied
    little whatever the overlap, and the other work follows the number of windows. `span` bounds the positions of a block.
    With `stride` windows start at its multiples, and `start` may restrict them further. Where they do not overlap, rows are gathered
    by the one window that holds them; where they do, windows are slices of blocks, too, so no row is copied to each of its windows.
    With `label` the set gets `labels` (NULLs when the column does not exist). With `ahead` the next `ahead` rows become
    `y_<channel>` and windows without a complete target are dropped.
    """
    known = label is not None and label in rows.columns
    fields = [*channels, *[c for c in (target_channels or []) if c not in channels]]
    item = F.struct(*fields, *([F.col(label).alias("_label")] if known else []))
    kept = rows.select(
        *dict.fromkeys([*keys, idx, *fields, *([label] if known else []), *carry]),
        (F.lit(True) if start is None else start).alias("_start"),
    )
    if stride and stride < length + ahead:
        kept = kept.withColumn("_start", F.col("_start") & (F.col(idx) % F.lit(stride) == 0))
    if stride and stride >= length + ahead:
        out = _grouped(kept, keys, idx, item, length, ahead, stride, carry)
    else:
        out = _blocked(kept, keys, idx, item, length, ahead, min(span, max(BLOCK, 2 * (length + ahead))), carry)
    out = out.where(F.col("_start") & (F.size("_w") == length))
    if ahead:
        out = out.where(F.size("_y") == ahead)
    cols = [F.col(f"_w.{c}").alias(c) for c in channels]
    if ahead:
        cols += [F.col(f"_y.{c}").alias(f"y_{c}") for c in (target_channels or channels)]
    if label is not None:
        cols.append(
            (F.col("_w._label") if known else F.array_repeat(F.lit(None).cast("int"), length)).alias("labels")
        )
    return out.select(*keys, F.col(idx).alias("start_idx"), *carry, *cols)


def _blocked(
    kept: DataFrame, keys: Sequence[str], idx: str, item: Column, length: int, ahead: int, size: int, carry: Sequence[str]
) -> DataFrame:
    """Slices of blocks of `size` positions at the marked rows: `_w`, `_y`, `_start` and `carry` of the first row."""
    pos, reach = F.col(idx), length + ahead
    first, own = F.floor((pos - F.lit(reach - 1)) / F.lit(size)).cast("long"), F.floor(pos / F.lit(size)).cast("long")
    spread = kept.withColumn("_b", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), own)))
    begins = F.coalesce(F.col("_start"), F.lit(False)) & (own == F.col("_b"))
    cell = F.struct(pos.alias("i"), item.alias("v"), F.when(begins, F.struct(F.lit(True).alias("on"), *carry)).alias("s"))
    blocks = spread.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(cell), lambda a, b: (a["i"] - b["i"]).cast("int")).alias("_a"))
    starts = F.filter(F.transform("_a", lambda x, p: F.struct(p.alias("p"), x["i"].alias("i"), x["s"].alias("s"))), lambda x: x["s"].isNotNull())

    def held(s: Column, low: int, count: int) -> Column:
        """The rows of `count` positions from `low` after the start; fewer where positions are missing."""
        part = F.slice("_a", s["p"] + (low + 1), F.lit(count))
        inside = lambda x: (x["i"] >= s["i"] + low) & (x["i"] < s["i"] + (low + count))
        return F.transform(F.filter(part, inside), lambda x: x["v"])

    # windows are cut before they are listed: a block is not copied to each of them
    cut = F.transform(starts, lambda s: F.struct(s["i"].alias("i"), s["s"].alias("s"), held(s, 0, length).alias("w"), *([held(s, length, ahead).alias("y")] if ahead else [])))
    each = blocks.where(F.exists("_a", lambda x: x["s"].isNotNull())).select(*keys, F.explode(cut).alias("_s"))
    marks = [F.col(f"_s.s.{c}").alias(c) for c in carry]
    return each.select(*keys, F.col("_s.i").alias(idx), F.lit(True).alias("_start"), *marks, F.col("_s.w").alias("_w"), *([F.col("_s.y").alias("_y")] if ahead else []))


def _grouped(
    kept: DataFrame, keys: Sequence[str], idx: str, item: Column, length: int, ahead: int, stride: int, carry: Sequence[str]
) -> DataFrame:
    """Rows gathered by the windows that hold them: `_w`, `_y`, `_start` and `carry` of the first row."""
    pos, reach = F.col(idx), length + ahead
    first = F.greatest(F.lit(0), F.ceil((pos - F.lit(reach - 1)) / F.lit(stride))).cast("long")
    held = F.sequence(first, F.floor(pos / F.lit(stride)).cast("long"))
    spread = kept.withColumn("_s", F.explode(F.when(first <= F.floor(pos / F.lit(stride)), held).otherwise(F.array().cast("array<bigint>"))))
    spread = spread.withColumn("_s", F.col("_s") * F.lit(stride))
    own = F.col(idx) == F.col("_s")
    gathered = spread.groupBy(*keys, "_s").agg(
        F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), item.alias("v")))).alias("_a"),
        F.coalesce(F.max(F.when(own, F.col("_start"))), F.lit(False)).alias("_start"),
        *[F.max(F.when(own, F.col(c))).alias(c) for c in carry],
    )
    inside = lambda lo, hi: F.transform(F.filter("_a", lambda x: (x["i"] >= F.col("_s") + lo) & (x["i"] < F.col("_s") + hi)), lambda x: x["v"])
    return gathered.select(*keys, F.col("_s").alias(idx), "_start", *carry, inside(0, length).alias("_w"), inside(length, reach).alias("_y"))


def whole_table_windows(rows: DataFrame, keys: Sequence[str], channels: Sequence[str], length: int, **options) -> DataFrame:
    """Non-overlapping windows over whole series."""
    return slide_windows(rows, keys, channels, length, stride=length, **options)


def clamp_starts(starts: DataFrame, keys: Sequence[str], length: int, idx: str = "idx", n: str = "n") -> DataFrame:
    """Starts too late for a complete window move back to the last complete one; series shorter than `length` drop out."""
    return (
        starts.where(F.col(n) >= length)
        .select(*keys, F.least(F.col(idx), F.col(n) - length).alias(idx))
        .distinct()
    )


def target_reconstruct(windows: DataFrame, channels: Sequence[str], out_window: int | None = None) -> DataFrame:
    """Add `y_<channel>`: the window itself, or its last `out_window` positions."""
    def tail(c: str) -> Column:
        return F.col(c) if out_window is None else F.slice(F.col(c), F.size(c) - (out_window - 1), out_window)

    return windows.withColumns({f"y_{c}": tail(c) for c in channels})


def infer_period(rows: DataFrame, keys: Sequence[str], us: str = "us", idx: str = "idx", span: int = SPAN) -> DataFrame:
    """Median step between successive times per series, in microseconds."""
    steps = framed(rows.select(*keys, idx, us), keys, idx, {"_p": (F.max(us), -1, -1)}, span)
    diffs = steps.where(F.col("_p").isNotNull()).select(*keys, (F.col(us) - F.col("_p")).alias("step"))
    return exact_quantiles(diffs, keys, "step", [0.5]).select(*keys, F.col("q").alias("period_us"))


def tumble_windows_wide(
    rows: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    n: int | Column,
    period_us: int | None = None,
    us: str = "us",
    tie: str = "event_id",
    idx: str = "idx",
    most: int | None = None,
) -> DataFrame:
    """Epoch-aligned windows of `n` periods that hold exactly `n` rows: `tile` (start time) and one array per channel.

    Rows with a missing channel are dropped first. Without `period_us` each series uses its own median step (rounded down to
    microseconds), for which rows need `idx`. `n` may differ from row to row; then `most` is its largest value. Of a tile only
    the first `most + 1` rows are gathered, which Spark cuts off before the shuffle: one more than fits tells that it is overfull.
    """
    size = F.lit(n) if isinstance(n, int) else n
    most = n if isinstance(n, int) else most
    if most is None:
        raise ValueError("say the largest n in most")
    full = rows.dropna(subset=list(channels))
    if period_us is None:
        full = spread_join(full, infer_period(rows, keys, us, idx), keys, idx).withColumn("_width", size * F.floor("period_us"))
    else:
        full = full.withColumn("_width", size * F.lit(period_us))
    tiled = full.withColumn("tile", (F.floor(F.col(us) / F.col("_width")) * F.col("_width")).cast("long")).withColumn("_n", size)
    group = [*keys, "tile"]
    first = tiled.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(us, tie))).where(F.col("_r") <= most + 1)
    packed = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(us, tie, *channels))).alias("_w"), F.max("_n").alias("_n"))
    return packed.where(F.size("_w") == F.col("_n")).select(*group, *[F.col(f"_w.{c}").alias(c) for c in channels])


def multi_length_windows(
    rows: DataFrame, keys: Sequence[str], channels: Sequence[str], lengths: Sequence[int], period_us: int, us: str = "us", tie: str = "event_id"
) -> DataFrame:
    """Tumbling windows for several lengths in one pass; `length` tells them apart."""
    fanned = rows.withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths])))
    return tumble_windows_wide(fanned, [*keys, "length"], channels, F.col("length"), period_us, us, tie, most=max(lengths))


def time_grid(
    rows: DataFrame, keys: Sequence[str], period_us: int, us: str, name: str = "grid_us", block: int = 10_000
) -> DataFrame:
    """Every multiple of the period between a series' first and last time.

    Points are produced in blocks that are spread over the cluster first, so one wide series is not one task.
    """
    ends = rows.groupBy(*keys).agg(F.min(us).alias("_a"), F.max(us).alias("_z"))
    blocks = ends.select(
        *keys, "_a", "_z", F.explode(F.sequence(F.col("_a"), F.col("_z"), F.lit(period_us * block))).alias("_s")
    ).repartition(*keys, "_s")
    last = F.least(F.col("_z"), F.col("_s") + F.lit(period_us * (block - 1)))
    return blocks.select(*keys, F.explode(F.sequence(F.col("_s"), last, F.lit(period_us))).alias(name))


def transpose_window(rows_first: Column, width: int) -> Column:
    """`[L][F]` to `[F][L]`."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda f: F.transform(rows_first, lambda r: F.get(r, f)))


def as_matrix(channels: Sequence[str]) -> Column:
    """Channel arrays of a window as `[L][F]`."""
    zipped = F.arrays_zip(*[F.col(c) for c in channels])
    return F.transform(zipped, lambda r: F.array(*[r[c] for c in channels]))


def concat_windows_sets(*sets: DataFrame) -> DataFrame:
    """All windows of several sets; columns a set lacks (such as labels) become NULL."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def explode_positions(windows: DataFrame, ids: Sequence[str], channels: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per (window, `pos`) with the channels as plain columns. `extra` are further array columns."""
    arrays = [*channels, *extra]
    zipped = F.arrays_zip(*[F.col(c) for c in arrays])
    long = windows.select(*ids, F.posexplode(zipped).alias("pos", "_z"))
    return long.select(*ids, "pos", *[F.col(f"_z.{c}").alias(c) for c in arrays])


def melt_channels(rows: DataFrame, ids: Sequence[str], channels: Sequence[str], value: str = "err") -> DataFrame:
    """One row per (ids, `channel`)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias(value)) for c in channels])
    return rows.select(*ids, F.inline(pairs))


def window_rank(windows: DataFrame, series: str = "series_id", start: str = "start_idx", name: str = "rank") -> DataFrame:
    """0-based rank of every window in (series, start) order over the whole set; windows of a null series come first."""
    starts = stage(windows.select(series, start), "starts")
    ranked = running(
        bucket_by_value(starts, series, start),
        [],
        [F.col(series), F.col(start)],
        {name: Running("count", F.lit(1), exclusive=True)},
    )
    ranks = ranked.select(null_safe([series, start]).alias("_k"), name)
    return windows.withColumn("_k", null_safe([series, start])).join(ranks, "_k", "inner").drop("_k")


def windows_to_timeline(
    ranked: DataFrame, length: int, channels: Sequence[str], extra: Sequence[str] = (), max_windows: int | None = None
) -> DataFrame:
    """Windows end to end: `t = rank * length + pos`."""
    if max_windows is not None:
        ranked = ranked.where(F.col("rank") < max_windows)
    long = explode_positions(ranked, ["rank"], channels, extra)
    return long.withColumn("t", F.col("rank") * F.lit(length) + F.col("pos"))


def timeline_blocks(timeline: DataFrame, length: int, max_windows: int) -> DataFrame:
    """Add `block`: pieces of `max_windows` windows."""
    return timeline.withColumn("block", F.floor(F.col("t") / F.lit(length * max_windows)).cast("long"))


def window_stats(windows: DataFrame, channels: Sequence[str], labels: str = "labels") -> DataFrame:
    """Count, length, channel count, whether labels are known, and size at 8 bytes per value."""
    has = labels in windows.columns
    known = F.exists(labels, lambda x: x.isNotNull()) if has else F.lit(False)
    size = F.size(channels[0])
    return windows.agg(
        F.count(F.lit(1)).alias("windows"),
        F.max(size).alias("length"),
        F.lit(len(channels)).alias("channels"),
        F.coalesce(F.max(known.cast("int")), F.lit(0)).alias("has_labels"),
        F.coalesce(F.sum(size.cast("long") * F.lit(len(channels) * 8)), F.lit(0)).alias("bytes"),
    )
