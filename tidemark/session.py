"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine expects. On a cluster, leave `master` and `partitions` unset."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", os.environ.get("TIDEMARK_UI", "false"))
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    """Number of buckets ordered operators cut their input into: follows the cluster's shuffle setting."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
