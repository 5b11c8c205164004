"""Helpers that several operators share: table access, folds, names that cannot clash, ordered buckets."""

from __future__ import annotations

import sys
import types

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an ordered bucket aims at, and the most buckets (their bounds and counts are held by the driver).
BUCKET_ROWS, MOST_BUCKETS = 1024, 1 << 16
#: Lowest 64-bit integer, the place of a null id in an order.
LOWEST = -(1 << 63)


#: Bytes of texts that go to a Python worker at once. Spark's own limit is sixteen times that, and each batch is held
#: several times: as vectors in the JVM, as Arrow data and as strings in the worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on an Arrow batch, unless it is as low already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = spark.conf.get(key).removesuffix("b")
    if set_to.isdigit() and int(set_to) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def own_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it (upper and lower case are equal in Spark)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ordered_buckets(df: DataFrame, id_col: str, hash_col: str, bucket_rows: int = BUCKET_ROWS):
    """A column that deals rows to buckets in ascending (id, hash) order, and the number of rows.

    Bucket bounds are quantiles of the id over all rows, so buckets are about equal whatever the ids are. An id
    that holds several quantiles (null, or repeated) has as many buckets, told apart by `hash_col` (64 bits).
    Bounds only balance the work: the order, and what is computed along it, does not depend on them.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    n = df.count()
    parts = min(MOST_BUCKETS, max(1, -(-n // bucket_rows)))
    bounds: list[int] = []
    if parts > 1:
        cuts = [i / parts for i in range(1, parts)]
        bounds = sorted(df.agg(F.percentile_approx(key, cuts, max(10_000, 10 * parts)).alias("q")).first()["q"])
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("long")
    def bucket(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        values = ids.to_numpy(np.int64)
        low, high = np.searchsorted(edges, values, "left"), np.searchsorted(edges, values, "right")
        # A share of the hash range for each repeat of the id among the bounds, in hash order.
        rank = (hashes.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        part = (rank * np.maximum(high - low, 1).astype(np.uint64)) >> np.uint64(32)
        return pd.Series(low + part.astype(np.int64))

    return bucket(key, F.col(hash_col)), n


def worker_held(key: str, make):
    """What `make` returns, made once in each Python worker and kept while the worker lives, over many tasks."""
    held = sys.modules.setdefault("_fleetline_worker", types.ModuleType("_fleetline_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
