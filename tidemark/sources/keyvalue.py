"""Experiment metadata files of `Key: value` lines, many files in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: keys of the metadata text and the columns they become
KEYS = {
    "Experiment": "exp_name",
    "Model": "model_name",
    "Dataset": "dataset_name",
    "Seed": "seed",
    "Filter anomalies": "filter_anomalies",
    "Sequence length": "seq_len",
    "Train indices": "train_size",
    "Val indices": "val_size",
    "Scaler": "scaler_type",
    "Scaler params": "scaler_params",
    "Feature columns": "feature_columns",
}


def scan_kv_files(spark: SparkSession, path: str) -> DataFrame:
    """Read files and parse them; `file` is the file name."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    lines = whole.select("file", F.posexplode(F.split("value", "\\r?\\n")).alias("pos", "line"))
    return parse_kv_lines(lines)


def parse_kv_lines(lines: DataFrame, file: str = "file", line: str = "line", pos: str = "pos", check: bool = True) -> DataFrame:
    """One typed row per file. Lines split at the first colon; unknown keys are ignored; of a repeated key the last line (by `pos`) counts.

    Parameters that are not valid JSON stay in `scaler_params_raw`. A file without `Feature columns` fails the job, also if it
    has no known key at all; with `check=False` its columns are null.
    """
    pair = F.split(F.trim(line), ":", 2)
    pairs = lines.select(file, pos, F.trim(F.get(pair, F.lit(0))).alias("key"), F.trim(F.get(pair, F.lit(1))).alias("value"))
    at = lambda k: F.when((F.col("key") == k) & F.col("value").isNotNull(), F.col(pos))
    wide = pairs.groupBy(file).agg(*[F.max_by("value", at(k)).alias(k) for k in KEYS])
    number = lambda k: F.regexp_replace(F.col(f"`{k}`"), ",", "").try_cast("long")
    features = F.transform(F.split(F.col("`Feature columns`"), ","), lambda x: F.trim(x))
    if check:
        features = F.coalesce(features, F.raise_error(F.concat(F.lit("no feature columns in "), F.col(file))).cast("array<string>"))
    params = F.from_json(F.col("`Scaler params`"), "map<string,string>", {"mode": "PERMISSIVE"})
    return wide.select(
        file,
        F.col("Experiment").alias("exp_name"),
        F.col("Model").alias("model_name"),
        F.col("Dataset").alias("dataset_name"),
        number("Seed").alias("seed"),
        (F.lower(F.col("`Filter anomalies`")) == "true").alias("filter_anomalies"),
        number("Sequence length").alias("seq_len"),
        number("Train indices").alias("train_size"),
        number("Val indices").alias("val_size"),
        F.col("Scaler").alias("scaler_type"),
        params.alias("scaler_params"),
        F.when(params.isNull(), F.col("`Scaler params`")).alias("scaler_params_raw"),
        features.alias("feature_columns"),
    )
