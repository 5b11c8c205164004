"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


PARTITION_MB = 128


def build_session(app: str = "fleetline", master: str | None = None, data_gb: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the package defaults; on a cluster `spark-submit` supplies the master.

    `data_gb` is the size of the largest shuffled table. Shuffles then start with partitions of about
    128 MB, which adaptive execution merges where less arrives.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sized = {}
    if data_gb:
        sized["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(
            max(200, data_gb * 1024 // PARTITION_MB))
    for key, value in {**DEFAULTS, **sized, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="fleetline-")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_dir()


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created until something is written."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df, label: str):
    """Write `df` to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = new_run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
