"""Errors, normalisation, scores, ROC and threshold metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import Running, bucket_by_value, count_cuts, double_array, exact_quantiles, null_safe, running
from tidemark.operators.clean import any_channel_over
from tidemark.sources.stage import stage

TINY = 1e-12
DISTRIBUTION_PROBS = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


# ---------------------------------------------------------------- errors

def elementwise_error(output: Column, target: Column, kind: str = "abs") -> Column:
    """`abs` or `se` (squared) error of one value."""
    if kind == "abs":
        return F.abs(output - target)
    if kind == "se":
        return (output - target) * (output - target)
    raise ValueError(f"unknown error type {kind!r}")


def window_errors(
    scored: DataFrame, ids: Sequence[str], channels: Sequence[str], kind: str = "abs", labels: str | None = "labels", target: str = ""
) -> DataFrame:
    """One row per (window, pos) with the error of each channel under the channel's name, and `label`.

    `target` is the prefix of the target arrays: empty for reconstruction, `y_` for forecasts.
    """
    arrays = [*[target + c for c in channels], *[f"out_{c}" for c in channels], *([labels] if labels else [])]
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    long = scored.select(*ids, F.posexplode(zipped).alias("pos", "_z"))
    return long.select(
        *ids,
        "pos",
        *[elementwise_error(F.col(f"_z.out_{c}"), F.col(f"_z.{target}{c}"), kind).alias(c) for c in channels],
        *([F.col(f"_z.{labels}").alias("label")] if labels else []),
    )


def mse_loss(scored: DataFrame, channels: Sequence[str], target: str = "") -> DataFrame:
    """Mean squared error over all elements."""
    errs = window_errors(scored, [], channels, "se", None, target)
    total = sum(F.sum(c) for c in channels)
    count = sum(F.count(c) for c in channels)
    return errs.agg((total / count).alias("mse"), count.alias("elements"))


def channel_error_stats(errors: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Mean and sample std of the error per channel."""
    wide = errors.agg(
        *[F.avg(c).alias(f"{c}|m") for c in channels], *[F.stddev_samp(c).alias(f"{c}|s") for c in channels]
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(f"`{c}|m`").alias("mean"), F.col(f"`{c}|s`").alias("std")) for c in channels
    ])
    return wide.select(F.inline(rows))


def by_channel(table: DataFrame, value: Column | str) -> dict[str, Column]:
    """A (channel, ...) table as one constant per channel; it has as many rows as there are channels."""
    value = F.col(value) if isinstance(value, str) else value
    return {c: F.lit(x).cast("double") for c, x in table.select("channel", value).collect()}


def threshold_flags(errors: DataFrame, stats: DataFrame, channels: Sequence[str], n_std: float = 3.0, name: str = "flag") -> DataFrame:
    """1 on time steps where some channel's error exceeds its own `mean + n_std * std`."""
    limits = by_channel(stats, F.col("mean") + F.lit(float(n_std)) * F.col("std"))
    return errors.withColumn(name, any_channel_over({c: F.col(c) for c in channels}, limits))


def error_distribution(errors: DataFrame, keys: Sequence[str], value: str = "err", probs: dict[str, float] | None = None) -> DataFrame:
    """Mean, population std, min, max and exact quantiles of `value` per key."""
    probs = DISTRIBUTION_PROBS if probs is None else probs
    basics = errors.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    q = exact_quantiles(errors, keys, value, list(probs.values()))
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in probs.items()])
    both = basics.withColumn("_k", null_safe(keys)).join(wide.withColumn("_k", null_safe(keys)).drop(*keys), "_k")
    return both.drop("_k")


def median_normaliser(normal_long: DataFrame, value: str = "err", keys: Sequence[str] = ()) -> DataFrame:
    """Median error of each channel over normal windows: (keys, channel, factor)."""
    q = exact_quantiles(normal_long, [*keys, "channel"], value, [0.5])
    return q.select(*keys, "channel", F.col("q").alias("factor"))


def normalise(errors: DataFrame, factors: DataFrame, channels: Sequence[str], epsilon: float = 1e-3) -> DataFrame:
    """Errors divided by `factor + epsilon` of their channel."""
    by = by_channel(factors, "factor")
    return errors.withColumns({c: F.col(c) / (by[c] + F.lit(epsilon)) for c in channels})


# ---------------------------------------------------------------- scores and labels

def mean_of(channels: Sequence[str]) -> Column:
    """Mean over channel columns."""
    return sum(F.col(c) for c in channels) / F.lit(float(len(channels)))


def step_score(errors: DataFrame, ids: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Score of a time step: mean over channels; its label is the mask at that step."""
    return errors.select(*ids, "pos", mean_of(channels).alias("score"), (F.coalesce("label", F.lit(0)) > 0).cast("int").alias("label"))


def sequence_score(errors: DataFrame, ids: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Score of a window: mean over time and channels; its label is 1 if any step is."""
    return errors.groupBy(*ids).agg(F.avg(mean_of(channels)).alias("score"), F.max(F.coalesce("label", F.lit(0))).alias("label"))


def step_score_window_label(scored_windows: DataFrame, ids: Sequence[str], channels: Sequence[str], kind: str = "abs") -> DataFrame:
    """Step scores whose label is the whole window's: 1 on every step of a window with any anomaly."""
    marked = scored_windows.withColumn("_any", F.coalesce(F.exists("labels", lambda y: y == 1), F.lit(False)).cast("int"))
    errs = window_errors(marked, [*ids, "_any"], channels, kind, None)
    return errs.select(*ids, "pos", mean_of(channels).alias("score"), F.col("_any").alias("label"))


# ---------------------------------------------------------------- ROC

def _rate(part: str, whole: str) -> Column:
    """Share, NULL when the class is empty."""
    return F.try_divide(F.col(part), F.col(whole))


def roc_counts(scores: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Per key and distinct score: `pos`, `neg` at it, `tp`, `fp` at or above it, and the key's totals `p`, `n`.

    Ties collapse first; the cumulative counts are running sums over score buckets. Null scores are left out; a score that is
    not a number has no place in the order and fails the job.
    """
    keys = list(keys)
    value = F.col(score).cast("double")
    checked = F.when(F.isnan(value), F.raise_error(F.lit("a score is not a number")).cast("double")).otherwise(value)
    grouped = stage(
        scores.where(F.col(score).isNotNull()).groupBy(*keys, checked.alias("score")).agg(
            F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
        ),
        "roc",
    )
    return running(
        bucket_by_value(grouped, "score", descending=True),
        keys,
        [-F.col("score")],
        {"tp": Running("sum", F.col("pos")), "fp": Running("sum", F.col("neg"))},
        {"p": ("sum", F.col("pos")), "n": ("sum", F.col("neg"))},
    )


def roc_curve(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the start (infinity, 0, 0)."""
    points = counts.select(
        *keys, F.col("score").alias("threshold"), _rate("fp", "n").alias("fpr"), _rate("tp", "p").alias("tpr")
    )
    origin = counts.groupBy(*keys).agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def _pairs_won() -> Column:
    return F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") + F.col("pos") / F.lit(2.0)))


def roc_auc(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area, ties counting half; NULL when a class is missing."""
    pn = F.max("p").cast("double") * F.max("n")
    return counts.groupBy(*keys).agg(F.try_divide(_pairs_won(), pn).alias("roc_auc"))


def youden_threshold(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold, rates and class totals at the first maximum of `tpr - fpr` (the largest threshold on ties)."""
    gain = _rate("tp", "p") - _rate("fp", "n")
    best = counts.groupBy(*keys).agg(
        F.max(F.struct(gain.alias("j"), "score", "tp", "fp")).alias("b"), F.max("p").alias("p"), F.max("n").alias("n")
    )
    some = F.col("b.j") > 0
    return best.select(
        *keys,
        F.when(some, F.col("b.score")).otherwise(F.lit(float("inf"))).alias("threshold"),
        F.when(some, _rate("b.tp", "p")).otherwise(F.lit(0.0)).alias("tpr"),
        F.when(some, _rate("b.fp", "n")).otherwise(F.lit(0.0)).alias("fpr"),
        "p",
        "n",
    )


def f1_from_rates(rates: DataFrame) -> DataFrame:
    """Add precision, recall and F1 estimated from `tpr`, `fpr` and the class totals `p`, `n`."""
    hits = F.col("tpr") * F.col("p")
    precision = hits / (hits + F.col("fpr") * F.col("n") + TINY)
    with_p = rates.withColumns({"precision": precision, "recall": F.col("tpr")})
    return with_p.withColumn(
        "f1", F.lit(2.0) * (F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall") + TINY)
    )


def best_f1_threshold(scores: DataFrame, num_thresh: int = 100, score: str = "score", label: str = "label") -> DataFrame:
    """F1 at `num_thresh` evenly spaced quantiles of the score; the first maximum."""
    scores = stage(scores.select(F.col(score).alias("score"), F.col(label).alias("label")), "f1")
    probs = [i / (num_thresh - 1) for i in range(num_thresh)]
    grid = double_array(sorted(row["q"] for row in exact_quantiles(scores, [], "score", probs).collect()))
    levels = scores.withColumn("m", count_cuts(grid, F.col("score"), num_thresh, True)).groupBy("m").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    # at most num_thresh + 1 rows from here on
    above = Window.partitionBy(F.lit(0)).orderBy(F.col("m").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    cum = levels.select(
        "m", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(everything).alias("p")
    )
    packed = cum.agg(F.collect_list(F.struct("m", "tp", "fp", "p")).alias("c")).withColumn("q", grid)
    each = packed.select("c", F.posexplode("q").alias("i", "threshold"))
    reach = F.array_sort(F.filter("c", lambda r: r["m"] > F.col("i")))
    at = each.select("i", "threshold", F.get(reach, F.lit(0)).alias("r"))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("r.tp"), F.col("r.tp") + F.col("r.fp") + F.col("r.p")), F.lit(0.0))
    best = at.select("i", "threshold", f1.alias("f1")).agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("i"))).alias("b"))
    return best.select("b.threshold", "b.f1")


def metrics_record(
    scores: DataFrame, keys: Sequence[str] = (), normals_from: str = "evaluation_set", score: str = "score", label: str = "label"
) -> DataFrame:
    """One row per key: AUC, rates, Youden threshold, F1, precision, recall, class totals and where the normals came from."""
    counts = roc_counts(scores, keys, score, label)
    gain = _rate("tp", "p") - _rate("fp", "n")
    pn = F.max("p").cast("double") * F.max("n")
    one = counts.groupBy(*keys).agg(
        F.try_divide(_pairs_won(), pn).alias("roc_auc"),
        F.max(F.struct(gain.alias("j"), "score", "tp", "fp")).alias("b"),
        F.max("p").alias("p"),
        F.max("n").alias("n"),
    )
    some = F.col("b.j") > 0
    rates = one.select(
        *keys, "roc_auc", "p", "n",
        F.when(some, F.col("b.score")).otherwise(F.lit(float("inf"))).alias("threshold"),
        F.when(some, _rate("b.tp", "p")).otherwise(F.lit(0.0)).alias("tpr"),
        F.when(some, _rate("b.fp", "n")).otherwise(F.lit(0.0)).alias("fpr"),
    )
    return f1_from_rates(rates).withColumn("normals_from", F.lit(normals_from))
