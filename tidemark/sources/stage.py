"""Intermediate tables in the cluster's shared folder.

A table that several passes read is written once as parquet: lineage ends there, later passes prune columns, and a lost
executor only re-reads files. The folder is the one the session names in `spark.checkpoint.dir`.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Only a local-mode session without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_STAGED: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, name: str, suffix: str = "") -> str:
    """A path of its own under the shared folder, removed by `clear_stages`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}{suffix}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete these tables from `stage` now. Every table and result that is still read must have been written, not only planned."""
    for df in tables:
        own = _STAGED.get(df.sparkSession.sparkContext.applicationId, [])
        for folder in {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}:
            for path in [p for p in own if p.rsplit("/", 1)[-1] == folder]:
                _delete(df.sparkSession, path)
                own.remove(path)


def stage_result(spark: SparkSession, build: Callable[[], DataFrame], name: str = "stage") -> DataFrame:
    """`stage` of what `build` returns, after which the tables that `build` staged on its way are released."""
    before = set(_STAGED.get(spark.sparkContext.applicationId, []))
    out = stage(build(), name)
    own = _STAGED[spark.sparkContext.applicationId]
    for path in [p for p in own[:-1] if p not in before]:
        _delete(spark, path)
        own.remove(path)
    return out


def clear_stages(spark: SparkSession) -> int:
    """Delete everything under paths from `fresh_path` in this application; call it when no result that reads those tables is needed any more."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
