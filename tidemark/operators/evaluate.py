"""Evaluation of a detector on a labelled window set, from errors to one full record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import exact_quantiles
from tidemark.operators.score import DISTRIBUTION_PROBS, metrics_record
from tidemark.operators.split import sample_normals
from tidemark.sources.stage import stage

SOURCES = ("evaluation_set", "validation")


def evaluate(
    anomalous: DataFrame,
    normal: DataFrame,
    ids: Sequence[str],
    channels: Sequence[str],
    normals_from: str = "evaluation_set",
    ratio: float = 1.0,
    epsilon: float = 1e-5,
    seed: int = 123,
    level: str = "step",
) -> tuple[DataFrame, DataFrame]:
    """One full record, and the ids of the normal windows that were sampled for it.

    `anomalous` and `normal` hold errors per (ids, pos) and channel; `anomalous` has `label`, and every step of `normal` counts as 0.
    `normal` may be the clean windows of the evaluation set or errors of the validation set from outside (`normals_from`). A seeded
    sample of `min(int(anomalous windows * ratio), normal windows)` of them is used. Its median error by channel divides all errors; the
    score of a step (or window, by `level`) is the mean over channels.

    The record has the metrics (AUC, threshold, rates, precision, recall, F1, class totals), `normal_stats` and `anomaly_stats` (count, mean,
    population std, min, max and quantiles of all raw errors of the class), `normalisation` (factor by channel), the numbers of windows,
    and a digest of the sampled ids, which themselves are a table: they can be many. All statistics come from one aggregate and one
    order of errors. An error that is missing or not a number fails the job.
    """
    if normals_from not in SOURCES:
        raise ValueError(f"normals_from is one of {SOURCES}")
    if level not in ("step", "window"):
        raise ValueError("level is step or window")
    ids, channels = list(ids), list(channels)
    bad = stage(anomalous.select(*ids, "pos", *channels, (F.coalesce("label", F.lit(0)) > 0).cast("int").alias("label"), F.lit(1).alias("anomalous")), "anomalous")
    windows = normal.select(*ids).distinct()
    sampled = stage(sample_normals(windows, bad.select(*ids).distinct(), ids, ratio, seed), "sampled")
    key = F.struct(*[F.col(c) for c in ids])
    chosen = normal.withColumn("_k", key).join(sampled.select(key.alias("_k")), "_k", "left_semi")
    both = stage(bad.unionByName(chosen.select(*ids, "pos", *channels, F.lit(0).alias("label"), F.lit(0).alias("anomalous"))), "evaluated")

    def sound(c: str):
        value = F.col(c).cast("double")
        return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"error of {c} is missing or not a number")).cast("double")).otherwise(value)

    parts = F.array(*[F.struct(F.lit(c).alias("channel"), sound(c).alias("err")) for c in channels])
    long = both.select("anomalous", F.inline(parts))
    # each error counts for its class, and a normal one for its channel, too
    groups = F.when(F.col("anomalous") == 1, F.array(F.lit("anomaly"))).otherwise(F.array(F.lit("normal"), F.concat(F.lit("channel|"), "channel")))
    grouped = long.select(F.explode(groups).alias("group"), "err")
    basics = grouped.groupBy("group").agg(F.count("err").alias("count"), F.avg("err").alias("mean"), F.stddev_pop("err").alias("std"), F.min("err").alias("min"), F.max("err").alias("max"))
    names = list(DISTRIBUTION_PROBS)
    # one order for each class; those of the channels, whose medians alone are used, share the normal one's
    every, normals = list(DISTRIBUTION_PROBS.values()), F.col("anomalous") == 0
    parts_of = {"anomaly": (~normals, every), "normal": (normals, every), **{f"channel|{c}": (normals & (F.col("channel") == c), [DISTRIBUTION_PROBS["median"]]) for c in channels}}
    quantiles = exact_quantiles(long, ["anomalous"], "err", [], parts=parts_of).withColumnRenamed("part", "group")
    wide = quantiles.groupBy("group").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in DISTRIBUTION_PROBS.items()])
    table = stage(basics.join(wide, "group"), "statistics")  # two rows and one for each channel
    fields = ["count", "mean", "std", "min", "max", *names]
    factors = {r["group"].removeprefix("channel|"): r["median"] for r in table.where(F.col("group").startswith("channel|")).select("group", "median").collect()}
    if not factors:
        raise ValueError("there is no normal window to evaluate against")
    scores = both.select(*ids, "anomalous", mean_of_normalised(channels, factors, epsilon).alias("score"), "label")
    if level == "window":
        scores = scores.groupBy(*ids, "anomalous").agg(F.avg("score").alias("score"), F.max("label").alias("label"))
    record = metrics_record(scores, [], normals_from)

    def stats_of(group: str):
        return F.max(F.when(F.col("group") == group, F.struct(*fields))).alias(f"{group}_stats")

    held = table.agg(stats_of("normal"), stats_of("anomaly"), F.map_from_entries(F.collect_list(F.when(F.col("group").startswith("channel|"), F.struct(F.substring("group", 9, 1 << 30), "median")))).alias("normalisation"))
    counted = both.select("anomalous", *ids).distinct().agg(F.count_if(F.col("anomalous") == 0).alias("normal_windows"), F.count_if(F.col("anomalous") == 1).alias("anomalous_windows"), F.bit_xor(F.when(F.col("anomalous") == 0, F.xxhash64(*ids))).alias("sampled_digest"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(record).join(one(held), "_one").join(one(counted), "_one").drop("_one"), sampled


def mean_of_normalised(channels: Sequence[str], factors: dict[str, float], epsilon: float):
    """Mean over channels of errors divided by `factor + epsilon`."""
    return sum(F.col(c) / F.lit(factors[c] + epsilon) for c in channels) / F.lit(float(len(channels)))
