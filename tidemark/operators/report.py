"""Error report tables: the data behind the plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import exact_quantiles
from tidemark.operators.clean import has_anomaly
from tidemark.operators.joins import join_pairs
from tidemark.operators.score import error_distribution, mean_of
from tidemark.operators.split import take_ranked


def paired_errors(corrupted_err: DataFrame, clean_err: DataFrame, origin: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Error of each corrupted step beside the error of the same step in its clean original."""
    ids = [*origin, "pos"]
    return join_pairs(corrupted_err.select(*ids, *channels), clean_err.select(*ids, *channels), ids)


def mean_gap(errors: DataFrame, channels: Sequence[str], anomalous: str = "anomalous") -> DataFrame:
    """Mean normal error, mean anomalous error, difference, and difference in percent of the normal one."""
    level = mean_of(channels)
    means = errors.agg(
        F.avg(F.when(F.col(anomalous) == 0, level)).alias("normal_mean"),
        F.avg(F.when(F.col(anomalous) == 1, level)).alias("anomaly_mean"),
    )
    gap = F.col("anomaly_mean") - F.col("normal_mean")
    return means.withColumns({"difference": gap, "percent": F.try_divide(F.lit(100.0) * gap, F.col("normal_mean"))})


def window_error_totals(errors: DataFrame, ids: Sequence[str], channels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Total error per window, summarised per `by`: count, mean, sample std, min, max."""
    totals = errors.groupBy(*ids, *by).agg(F.sum(sum(F.col(c) for c in channels)).alias("total"))
    return totals.groupBy(*by).agg(
        F.count("total").alias("windows"), F.avg("total").alias("mean"), F.stddev_samp("total").alias("std"),
        F.min("total").alias("min"), F.max("total").alias("max"),
    )


def class_error_stats(scores: DataFrame, by: Sequence[str], value: str = "score") -> DataFrame:
    """Mean, population std, median and .95 quantile per class."""
    stats = error_distribution(scores, by, value, {"median": 0.5, "q95": 0.95})
    return stats.select(*by, "count", "mean", "std", "median", "q95")


def global_error_timeline(timeline: DataFrame, channels: Sequence[str], anomalous: str = "anomalous", share: float = 0.95) -> DataFrame:
    """Per block: quantile of the normal global error as threshold, and per class the steps, mean, and share above it."""
    level = timeline.select("block", anomalous, mean_of(channels).alias("err"))
    limits = exact_quantiles(level.where(F.col(anomalous) == 0), ["block"], "err", [share]).select(
        "block", F.col("q").alias("threshold")
    )
    marked = level.join(limits, "block", "left")
    over = F.col("err") > F.col("threshold")
    return marked.groupBy("block", anomalous).agg(
        F.max("threshold").alias("threshold"),
        F.count(F.lit(1)).alias("steps"),
        F.avg("err").alias("mean_err"),
        F.count_if(over).alias("above"),
        F.avg(F.coalesce(over.cast("double"), F.lit(0.0))).alias("share_above"),
    )


def channel_ranges(scored: DataFrame, channels: Sequence[str], keys: Sequence[str] = (), margin: float = 0.05) -> DataFrame:
    """Shared value range (targets and outputs) and error range per channel, widened by `margin`.

    `scored` is the long form with columns `<c>` (target), `out_<c>` and `err_<c>`.
    """
    wide = scored.groupBy(*keys).agg(
        *[F.least(F.min(c), F.min(f"out_{c}")).alias(f"{c}|vl") for c in channels],
        *[F.greatest(F.max(c), F.max(f"out_{c}")).alias(f"{c}|vh") for c in channels],
        *[F.min(f"err_{c}").alias(f"{c}|el") for c in channels],
        *[F.max(f"err_{c}").alias(f"{c}|eh") for c in channels],
    )

    def ends(c: str, kind: str, name: str):
        low, high = F.col(f"`{c}|{kind}l`"), F.col(f"`{c}|{kind}h`")
        pad = (high - low) * F.lit(margin)
        return (low - pad).alias(f"{name}_low"), (high + pad).alias(f"{name}_high")

    rows = F.array(*[F.struct(F.lit(c).alias("channel"), *ends(c, "v", "value"), *ends(c, "e", "error")) for c in channels])
    return wide.select(*keys, F.inline(rows))


def error_histogram(scores: DataFrame, by: str, value: str = "score", bins: int = 50) -> DataFrame:
    """Density histogram of each class over the class's own range; the last bin includes the maximum.

    `by` must be a 0/1 class column.
    """
    classed = scores.where(F.col(by).isin(0, 1))
    ranges = classed.groupBy(by).agg(F.min(value).alias("a"), F.max(value).alias("z"), F.count(value).alias("n")).collect()
    r = F.coalesce(F.lit(None).cast("struct<a:double,z:double,n:bigint>"), *[
        F.when(
            F.col(by) == row[by],
            F.struct(F.lit(float(row["a"])).alias("a"), F.lit(float(row["z"])).alias("z"), F.lit(row["n"]).cast("bigint").alias("n")),
        )
        for row in ranges
    ])
    placed = classed.select(by, F.col(value).alias("_v"), r.alias("_r"))
    width = F.when(F.col("_r.z") > F.col("_r.a"), (F.col("_r.z") - F.col("_r.a")) / F.lit(bins))
    spot = F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col("_v") - F.col("_r.a")) / width), F.lit(0))).cast("int")
    return placed.select(by, spot.alias("bin"), width.alias("_w"), F.col("_r.n").alias("_n")).groupBy(by, "bin").agg(
        F.count(F.lit(1)).alias("count"), (F.count(F.lit(1)) / (F.max("_n") * F.max("_w"))).alias("density")
    )


def sample_pairs(
    pairs: DataFrame,
    ids: Sequence[str],
    channels: Sequence[str],
    share: float,
    limit: int,
    prefix: str = "clean_",
    seed: int = 123,
    total: str = "n_windows",
) -> DataFrame:
    """Seeded sample of anomalous windows for inspection: `min(int(N * share), limit)` of them, N being all windows.

    Each comes with its original and corrupted channel and the clean previous and next channel in channel order.
    """
    n = pairs.agg(F.max(total).alias("n")).first()["n"] or 0
    chosen = take_ranked(pairs.where(has_anomaly("labels")), ids, min(int(n * float(share)), limit), seed, "sample")
    order = list(channels)

    def neighbour(step: int):
        cases = [
            F.when(F.col("channel") == c, F.col(prefix + order[i + step]))
            for i, c in enumerate(order)
            if 0 <= i + step < len(order)
        ]
        return F.coalesce(*cases)

    pick = lambda p: F.coalesce(*[F.when(F.col("channel") == c, F.col(p + c)) for c in order])
    return chosen.select(
        *ids, "rank", "anomaly_type", "channel", "labels",
        pick(prefix).alias("original"), pick("").alias("corrupted"),
        neighbour(-1).alias("previous"), neighbour(1).alias("next"),
    )
