"""Synthetic anomalies in clean windows.

Windows carry one array per channel. A chosen window gets one anomaly type on one channel. Every random choice is a hash of
(seed, purpose, window), so a window is distorted the same way wherever and however often it is computed.

Strength: `delta` is the mean squared change per step in units of the channel's variance over all windows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions.moments import array_moments
from tidemark.functions.ordered import SPAN, Running, bucket_by_digest, null_safe, running
from tidemark.operators.clean import has_anomaly
from tidemark.operators.score import by_channel
from tidemark.operators.split import take_ranked
from tidemark.operators.windows import concat_windows_sets
from tidemark.sources.stage import stage


@dataclass(frozen=True)
class Setting:
    """What an injector may use: strength, fitted channel spread, seed, window ids, window length, principal directions."""

    delta: float
    spread: Column
    seed: int
    ids: Sequence[str]
    length: int
    mean: Column | None = None
    direction: Column | None = None
    extra: dict = field(default_factory=dict)

    def number(self, purpose: str, *more: Column) -> Column:
        return hashing.uniform(self.seed, purpose, *self.ids, *more)

    @property
    def sign(self) -> Column:
        return F.when(self.number("sign") < 0.5, -1.0).otherwise(1.0)

    @property
    def place(self) -> Column:
        return F.floor(self.number("place") * self.length).cast("int")


def inject_gwn(x: Column, s: Setting) -> Column:
    """White Gaussian noise: `z + sqrt(delta) * spread * n`."""
    size = F.lit(math.sqrt(s.delta)) * s.spread
    return F.transform(x, lambda z, i: z + size * hashing.normal(s.seed, "gwn", *s.ids, i))


def inject_constant(x: Column, s: Setting) -> Column:
    """Constant offset: `z + sign * sqrt(delta) * spread`."""
    shift = s.sign * math.sqrt(s.delta) * s.spread
    return F.transform(x, lambda z: z + shift)


def inject_step(x: Column, s: Setting) -> Column:
    """Offset from a random position p on: `z + sign * sqrt(delta * L / (L - p)) * spread`."""
    p = s.place
    shift = s.sign * F.sqrt(F.lit(s.delta * s.length) / (F.lit(s.length) - p)) * s.spread
    return F.transform(x, lambda z, i: F.when(i >= p, z + shift).otherwise(z))


def inject_impulse(x: Column, s: Setting) -> Column:
    """One altered position: `z + sign * sqrt(delta * L) * spread`."""
    p = s.place
    shift = s.sign * math.sqrt(s.delta * s.length) * s.spread
    return F.transform(x, lambda z, i: F.when(i == p, z + shift).otherwise(z))


def inject_narrowband(x: Column, s: Setting, low: float = 0.1, width: float = 0.1, tones: int = 3) -> Column:
    """Narrow-band noise: `tones` sinusoids of equal power, frequency in [low, low + width) cycles per step, random phase."""
    size = F.lit(math.sqrt(2.0 * s.delta / tones)) * s.spread

    def wave(i: Column, m: int) -> Column:
        freq = F.lit(low) + F.lit(width) * s.number(f"freq{m}")
        phase = F.lit(2.0 * math.pi) * s.number(f"phase{m}")
        return F.cos(F.lit(2.0 * math.pi) * freq * i + phase)

    def add(z: Column, i: Column) -> Column:
        total = wave(i, 0)
        for m in range(1, tones):
            total = total + wave(i, m)
        return z + size * total

    return F.transform(x, add)


def inject_subspace(x: Column, s: Setting) -> Column:
    """Moves the window against its first principal component: `z - sign(c) * sqrt(delta * L) * spread * w`."""
    pairs = F.arrays_zip(x.alias("z"), s.mean.alias("m"), s.direction.alias("w"))
    score = F.aggregate(pairs, F.lit(0.0), lambda acc, r: acc + (r["z"] - r["m"]) * r["w"])
    size = F.when(score < 0, -1.0).otherwise(1.0) * math.sqrt(s.delta * s.length) * s.spread
    return F.zip_with(x, s.direction, lambda z, w: z - size * w)


INJECTORS: dict[str, Callable[[Column, Setting], Column]] = {
    "gwn": inject_gwn,
    "constant": inject_constant,
    "step": inject_step,
    "impulse": inject_impulse,
    "narrowband": inject_narrowband,
    "subspace": inject_subspace,
}


def known_types(types: Sequence[str], on_unknown: str = "error") -> list[str]:
    """The types that have an injector. A name without one is an error, or is left out with a warning (`on_unknown='warn'`)."""
    unknown = [t for t in types if t not in INJECTORS]
    known = [t for t in types if t in INJECTORS]
    if unknown and on_unknown != "warn":
        raise ValueError(f"no injector of this name: {', '.join(unknown)}")
    if unknown:
        warnings.warn(f"no injector of this name: {', '.join(unknown)}", stacklevel=2)
    if not known:
        raise ValueError("no injector is named")
    return known


def pick_windows(windows: DataFrame, ids: Sequence[str], ratio: float, seed: int = 123) -> DataFrame:
    """`int(N * ratio)` windows without replacement; `rank` is the choice order."""
    k = (F.col("rank_n").cast("double") * F.lit(float(ratio))).cast("long")
    return take_ranked(windows, ids, k, seed, "pick")


def pick_type_channel(
    windows: DataFrame,
    ids: Sequence[str],
    types: Sequence[str],
    channels: Sequence[str],
    only: Sequence[str] | None = None,
    seed: int = 123,
) -> DataFrame:
    """Add `anomaly_type` and `channel`, each uniform; `only` restricts the channels by name. `known_types` checks the types."""
    types = known_types(types)
    pool = [c for c in channels if only is None or c in only]

    def choose(options: Sequence[str], purpose: str) -> Column:
        at = F.floor(hashing.uniform(seed, purpose, *ids) * len(options)).cast("int")
        return F.get(F.array(*[F.lit(o) for o in options]), at)

    return windows.withColumns({"anomaly_type": choose(types, "type"), "channel": choose(pool, "channel")})


def injector_fit(windows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Mean and population std of every channel over all steps of all windows, and the number of steps."""
    flat = windows.select(F.inline(F.arrays_zip(*[F.col(c) for c in channels])))
    wide = flat.agg(
        *[F.avg(c).alias(f"{c}|m") for c in channels],
        *[F.stddev_pop(c).alias(f"{c}|s") for c in channels],
        *[F.count(c).alias(f"{c}|n") for c in channels],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("channel"), *[F.col(f"`{c}|{k}`").alias(n) for k, n in (("m", "mean"), ("s", "std"), ("n", "steps"))])
        for c in channels
    ])
    return wide.select(F.inline(rows))


def principal_directions(windows: DataFrame, channels: Sequence[str]) -> dict[str, tuple[list[float], list[float]]]:
    """Per channel: mean window and first principal direction (arrays of the window length)."""
    out = {}
    for c, (_, mean, spread) in array_moments(windows, {c: F.col(c) for c in channels}).items():
        w = np.linalg.eigh(spread)[1][:, -1]
        w = w if w[abs(w).argmax()] > 0 else -w
        out[c] = ([float(m) for m in mean], [float(x) for x in w])
    return out


def corrupt(
    picked: DataFrame,
    fitted: DataFrame,
    ids: Sequence[str],
    channels: Sequence[str],
    length: int,
    delta: float = 0.5,
    seed: int = 123,
    types: Sequence[str] | None = None,
    directions: dict[str, tuple[list[float], list[float]]] | None = None,
) -> DataFrame:
    """Distort the chosen channel of each window and add 0/1 `labels` where it changed.

    Only changed positions are replaced. Without `types` all injectors may be named by the windows; `subspace` needs `directions`.
    """
    given = types
    types = known_types(types or INJECTORS)
    if given and "subspace" in types and not directions:
        raise ValueError("subspace needs directions")
    spreads = by_channel(fitted, "std")
    pick = lambda options: F.coalesce(*[F.when(F.col("channel") == c, v) for c, v in options.items()])
    doubles = lambda xs: F.array(*[F.lit(x) for x in xs])
    setting = Setting(
        delta,
        F.col("_spread"),
        seed,
        ids,
        length,
        pick({c: doubles(directions[c][0]) for c in channels}) if directions else None,
        pick({c: doubles(directions[c][1]) for c in channels}) if directions else None,
    )
    before = picked.withColumn("_old", pick({c: F.col(c) for c in channels})).withColumn(
        "_spread", pick(spreads)
    )
    cases = [F.when(F.col("anomaly_type") == t, INJECTORS[t](F.col("_old"), setting)) for t in types if t != "subspace" or directions]
    after = before.withColumn("_new", F.coalesce(*cases, F.col("_old")))
    marked = after.withColumn("labels", change_mask(F.col("_old"), F.col("_new")))
    merged = marked.withColumn(
        "_new", F.zip_with(F.arrays_zip("_old", "_new"), F.col("labels"), lambda p, y: F.when(y == 1, p["_new"]).otherwise(p["_old"]))
    )
    return merged.withColumns(
        {c: F.when(F.col("channel") == c, F.col("_new")).otherwise(F.col(c)) for c in channels}
    ).drop("_old", "_new", "_spread")


def change_mask(old: Column, new: Column, tolerance: float = 1e-10) -> Column:
    """1 where the value moved by more than `tolerance` (0 asks for any difference)."""
    return F.zip_with(old, new, lambda a, b: (F.abs(a - b) > tolerance).cast("int"))


def keep_normal_values(corrupted: Column, original: Column, labels: Column) -> Column:
    """Original values back at label-0 positions, as needed after an inverse scaling."""
    pairs = F.arrays_zip(corrupted.alias("c"), original.alias("o"))
    return F.zip_with(pairs, labels, lambda p, y: F.when(y == 0, p["o"]).otherwise(p["c"]))


def really_changed(corrupted: DataFrame) -> DataFrame:
    """Chosen windows with at least one changed position; `rank` keeps the choice order."""
    return corrupted.where(has_anomaly("labels"))


def clean_plus_corrupted(
    clean: DataFrame, corrupted: DataFrame, length: int, include_clean: bool = True, origin: Sequence[str] = ("series_id", "start_idx")
) -> DataFrame:
    """Evaluation set: clean windows (`normal`/`none`, labels 0) and corrupted ones; or the corrupted ones only.

    The origin columns of a corrupted window are those of its clean original, which is the pairing map.
    """
    bad = really_changed(corrupted).withColumn("kind", F.lit("corrupted"))
    if not include_clean:
        return bad
    good = clean.drop("labels").withColumns({
        "kind": F.lit("clean"),
        "anomaly_type": F.lit("normal"),
        "channel": F.lit("none"),
        "labels": F.array_repeat(F.lit(0), length),
    })
    return concat_windows_sets(good, bad)


def corruption_map(corrupted: DataFrame, origin: Sequence[str]) -> DataFrame:
    """(origin window, choice rank) of every window that really changed."""
    return really_changed(corrupted).select(*origin, F.col("rank").alias("corrupted_rank"))


def original_anomaly_set(clean: DataFrame, anomalous: DataFrame, length: int) -> DataFrame:
    """Clean windows and real anomalous windows (`original`/`unknown`) with the share of anomalous steps."""
    good = clean.drop("labels").withColumns({
        "kind": F.lit("clean"), "anomaly_type": F.lit("normal"), "channel": F.lit("none"),
        "labels": F.array_repeat(F.lit(0), length),
    })
    real = anomalous.withColumns({
        "kind": F.lit("original"), "anomaly_type": F.lit("original"), "channel": F.lit("unknown"),
    })
    both = concat_windows_sets(good, real)
    ones = F.aggregate("labels", F.lit(0), lambda acc, y: acc + F.coalesce(y, F.lit(0)))
    return both.withColumn("density", ones.cast("double") / F.size("labels"))


def evaluation_set(
    strategy: str,
    clean: DataFrame,
    corrupted: DataFrame | None,
    anomalous: DataFrame | None,
    length: int,
    scaled: tuple[bool, bool] = (True, True),
) -> DataFrame | None:
    """Build the set for a strategy: `none`, `corrupt_validation`, `use_original` or `both`.

    With no real anomalies (`anomalous is None`) `use_original` and `both` fall back to `corrupt_validation`.
    """
    if strategy == "none":
        return None
    if strategy not in ("corrupt_validation", "use_original", "both"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if anomalous is None or strategy == "corrupt_validation":
        return clean_plus_corrupted(clean, corrupted, length)
    originals = original_anomaly_set(clean, anomalous, length)
    if strategy == "use_original":
        return originals
    if scaled[0] != scaled[1]:
        raise ValueError("both parts must be scaled alike")
    return concat_windows_sets(originals, clean_plus_corrupted(clean, corrupted, length, include_clean=False))


def injection_stats(eval_set: DataFrame, by: str) -> DataFrame:
    """Windows, anomalous windows, anomalous steps and their share by `by` (`anomaly_type`, `channel`, `kind`)."""
    ones = F.aggregate("labels", F.lit(0), lambda acc, y: acc + y)
    return eval_set.groupBy(by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(has_anomaly("labels")).alias("anomalous_windows"),
        F.sum(ones).cast("long").alias("anomalous_steps"),
        (F.sum(ones) / F.sum(F.size("labels"))).alias("share"),
    )


def check_untouched(pairs: DataFrame, channels: Sequence[str], prefix: str = "clean_", tolerance: float = 1e-8) -> DataFrame:
    """Per corrupted channel: pairs, largest change on the other channels, and pairs differing in exactly one channel."""
    gap = lambda c: F.array_max(F.zip_with(c, prefix + c, lambda a, b: F.abs(a - b)))
    gaps = pairs.withColumns({f"_g_{c}": gap(c) for c in channels})
    others = F.greatest(F.lit(0.0), *[F.when(F.col("channel") != c, F.col(f"_g_{c}")) for c in channels])
    moved = sum((F.col(f"_g_{c}") > tolerance).cast("int") for c in channels)
    return gaps.groupBy("channel").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.max(others).alias("max_other_change"),
        F.count_if(moved == 1).alias("one_channel_pairs"),
    )


def label_runs(
    sizes: DataFrame, keys: Sequence[str], share: float, min_len: int, max_len: int, seed: int = 42, n: str = "n", on_impossible: str = "error"
) -> DataFrame:
    """Random runs `keys, run, start, length`: exactly `int(n * share)` positions of each series, no two runs touching.

    `sizes` has one row per series. The number of runs is the one whose mean length is nearest to the middle of [min_len, max_len], as far
    as the target and the gaps between runs allow it. Lengths are drawn evenly; what their sum misses or exceeds is made up by moving
    runs, in random order, to their longest or shortest. Gaps are the steps between sorted draws, and starts are running sums. A series
    that no such runs fit fails the job, or gets none with `on_impossible='none'`.
    """
    if not 1 <= min_len <= max_len or on_impossible not in ("error", "none"):
        raise ValueError("min_len from 1 to max_len, and on_impossible 'error' or 'none'")
    cap, middle = max_len - min_len, (min_len + max_len) / 2
    target = (F.col(n).cast("double") * F.lit(share)).cast("long")
    plan = sizes.select(*keys, F.col(n).cast("long").alias("_n"), target.alias("_t"))
    low, high = F.ceil(F.col("_t") / max_len).cast("long"), F.least(F.floor(F.col("_t") / min_len).cast("long"), F.col("_n") - F.col("_t") + 1)
    fits = low <= high
    count = F.least(F.greatest(F.round(F.col("_t") / middle).cast("long"), low), high)
    if on_impossible == "error":
        told = F.concat(F.lit("no runs of this length cover "), F.col("_t"), F.lit(" of "), F.col("_n"), F.lit(" positions"))
        plan = plan.withColumn("_m", F.when(fits, count).otherwise(F.raise_error(told).cast("long")))
    else:
        plan = plan.where(fits).withColumn("_m", count)
    plan = plan.withColumn("_z", F.col("_n") - F.col("_t") - F.col("_m") + 1).where("_m > 0")
    block = 10_000
    blocks = plan.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(block).cast("long")))).repartition(*keys, "_s")
    drawn = blocks.withColumn("run", F.explode(F.sequence("_s", F.least(F.col("_m"), F.col("_s") + block) - 1))).drop("_s")
    drawn = drawn.withColumns({
        "_x": F.floor(hashing.uniform(seed, "len", *keys, "run") * (cap + 1)).cast("long"),
        "_g": F.floor(hashing.uniform(seed, "gap", *keys, "run") * (F.col("_z") + 1)).cast("long"),
        "_d": hashing.digest(seed, "fill", *keys, "run"),
    })
    filled = running(
        bucket_by_digest(drawn, "_d"), keys, [F.col("_d"), F.col("run")],
        {"_more": Running("sum", cap - F.col("_x"), exclusive=True), "_less": Running("sum", F.col("_x"), exclusive=True)}, {"_sum": ("sum", F.col("_x"))},
    )
    miss = F.col("_t") - F.col("_m") * min_len - F.col("_sum")
    up = F.least(F.greatest(miss - F.col("_more"), F.lit(0)), cap - F.col("_x"))
    down = F.least(F.greatest(-miss - F.col("_less"), F.lit(0)), F.col("_x"))
    sized = filled.withColumn("length", min_len + F.col("_x") + up - down).select(*keys, "run", "length", "_g", "_m", "_z")
    placed = sized.withColumn("_b", F.floor(F.col("_g").cast("double") * F.ceil(F.col("_m") / SPAN) / (F.col("_z") + 1)).cast("long"))
    placed = running(placed, keys, [F.col("_g"), F.col("run")], {"_before": Running("sum", F.col("length") + 1, exclusive=True)})
    return placed.select(*keys, "run", (F.col("_g") + F.col("_before")).cast("long").alias("start"), "length")


def random_label_runs(
    rows: DataFrame, keys: Sequence[str], share: float, min_len: int, max_len: int, seed: int = 42, idx: str = "idx", n: str = "n", on_impossible: str = "error"
) -> DataFrame:
    """Add `label`: random runs of 1 from `label_runs`, of `min_len` to `max_len` rows each, covering exactly `int(n * share)` rows of each series.

    Rows meet the few runs that reach their stretch of `max_len` positions, so no task holds a series.
    """
    sizes = rows.groupBy(*keys).agg(F.max(n).alias(n))
    runs = label_runs(sizes, keys, share, min_len, max_len, seed, n, on_impossible)
    ends = F.col("start") + F.col("length")
    part = F.explode(F.sequence(F.floor(F.col("start") / max_len).cast("long"), F.floor((ends - 1) / max_len).cast("long")))
    reached = runs.select(null_safe(keys).alias("_k"), part.alias("_p"), F.struct("start", ends.alias("end")).alias("r"))
    held = reached.groupBy("_k", "_p").agg(F.collect_list("r").alias("_runs"))  # max_len / (min_len + 1) + 2 at most
    met = rows.withColumns({"_k": null_safe(keys), "_p": F.floor(F.col(idx) / max_len).cast("long")}).join(held, ["_k", "_p"], "left")
    hit = F.exists("_runs", lambda r: (F.col(idx) >= r["start"]) & (F.col(idx) < r["end"]))
    return met.select(*[F.col(c) for c in rows.columns if c != "label"], F.coalesce(hit, F.lit(False)).cast("int").alias("label"))
