"""Saved artefacts: splits, scaler parameters, evaluation sets, run records."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def artefact_path(root: str, *parts: str | int | float) -> str:
    """Folder of an artefact, made of what decides its content (model, experiment, data set, length, strategy, seed, ...)."""
    return "/".join([root.rstrip("/"), *[str(p).replace("/", "_") for p in parts]])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished write is at `path`, on any file system the session can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def reuse_or_rebuild(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Read the artefact at `path` if it is complete; otherwise, or with `force`, build and write it anew."""
    if force or not path_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- splits

def sink_splits(splits: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """Write positions partitioned by `split`; metadata about the experiment goes along as constant columns."""
    out = splits.withColumns({k: F.lit(v) for k, v in (metadata or {}).items()})
    out.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All positions, or those of one split (only its folder is read)."""
    table = spark.read.parquet(path)
    return table if split is None else table.where(F.col("split") == split)


# ---------------------------------------------------------------- scaler

def sink_scaler(scaler: DataFrame, path: str) -> None:
    """Write the scaler table (one row per feature), the quantile range of a robust one included."""
    scaler.coalesce(1).write.mode("overwrite").json(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    """The scaler table as `scale_apply` takes it."""
    return spark.read.schema("pos int, feature string, kind string, center double, scale double, var double, n long, q_low double, q_high double").json(path)


# ---------------------------------------------------------------- evaluation set

def sink_eval(windows: DataFrame, path: str, metadata: dict) -> None:
    """Write windows and a one-row metadata table beside them."""
    windows.write.mode("overwrite").parquet(f"{path}/windows")
    spark = windows.sparkSession
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in metadata.items()])
    row.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_eval(spark: SparkSession, path: str, require_scaled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(windows, metadata). Old files without `is_standardized` count as scaled; unscaled data is refused."""
    metadata = spark.read.json(f"{path}/metadata")
    if "is_standardized" not in metadata.columns:
        metadata = metadata.withColumn("is_standardized", F.lit(True))
    if require_scaled and not metadata.first()["is_standardized"]:
        raise ValueError(f"{path} holds unscaled windows; scoring needs scaled ones")
    return spark.read.parquet(f"{path}/windows"), metadata


# ---------------------------------------------------------------- runs

def sink_results(results: DataFrame, path: str, run: str = "run_id", epoch: str = "epoch") -> None:
    """Publish result rows (one per run and epoch); publishing the same rows again changes nothing.

    Rows are written beside the table, in a folder that readers skip, and then renamed to a batch named by the runs and epochs it
    holds. So a failed job leaves nothing behind that is read, and a repeated one replaces its own batch.
    """
    spark = results.sparkSession
    beside = f"{path}/_new-{uuid.uuid4().hex}"
    results.withColumn("_written", F.lit(time.time_ns())).write.parquet(beside)
    keys = F.xxhash64(F.struct(F.col(run).cast("string"), F.col(epoch).cast("string")))
    held = spark.read.parquet(beside).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(keys).alias("x"), F.sum(keys.cast("decimal(20,0)")).alias("s")).first()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(beside), hadoop.Path(f"{path}/batch=b{held['n']}_{(held['x'] or 0) & (2**64 - 1):016x}_{int(held['s'] or 0) % 2**64:016x}")
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"could not publish {target}")


def read_results(spark: SparkSession, path: str, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """All result rows so far; of several for one run and epoch the one published last."""
    table = spark.read.option("mergeSchema", True).parquet(path)
    values = [c for c in table.columns if c not in (run, epoch, "batch", "_written")]
    latest = table.groupBy(run, epoch).agg(F.max_by(F.struct(*values), F.struct("_written", "batch")).alias("_v"))
    return latest.select(run, epoch, *[F.col("_v")[c].alias(c) for c in values])
