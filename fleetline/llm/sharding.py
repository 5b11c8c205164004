"""Sharding by a Feistel permutation over global row numbers.

Rows are numbered 0..n-1 in ascending order of (id, text hash). A four-round Feistel network with cycle walking
permutes 0..n-1; place p of a row gives shard `p mod shards` and slot `p div shards`, so both can be computed from
a row number alone, and shards differ by one row at most (law `rows`). The same rows, seed and shard count give the
same shards whatever the partitioning.

Defined results: null ids come first; null texts hash as empty ones; rows equal in id and text are interchangeable;
an empty table gives an empty result; further columns pass through, and a column named like a new one is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.llm.common import ordered_buckets, own_name

ROUNDS = 4
#: Odd multiplier of the round function; a fixed value of this permutation.
MULTIPLIER = 0x9E3779B1


def half_bits(n: int) -> int:
    """Bits of each half: the smallest even-width block that holds n values."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def round_keys(seed: int) -> list[int]:
    """Four 31-bit keys from a linear congruence, so that SQL can state them as numbers."""
    keys, x = [], seed & 0x7FFFFFFF
    for _ in range(ROUNDS):
        x = (x * 1103515245 + 12345) & 0x7FFFFFFF
        keys.append(x)
    return keys


def feistel(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each row number below n. Values that leave 0..n-1 are permuted again until they are inside."""
    bits = half_bits(n)
    mask = np.uint64((1 << bits) - 1)
    out = np.asarray(values, dtype=np.uint64).copy()
    open_ = np.ones(len(out), dtype=bool)
    while open_.any():
        left, right = out[open_] >> np.uint64(bits), out[open_] & mask
        for key in round_keys(seed):
            # Both factors are below 2**32, so the product does not overflow.
            mixed = ((right ^ np.uint64(key)) & np.uint64(0xFFFFFFFF)) * np.uint64(MULTIPLIER)
            left, right = right, left ^ ((mixed >> np.uint64(15)) & mask)
        out[open_] = (left << np.uint64(bits)) | right
        open_[open_] = out[open_] >= np.uint64(n)
    return out.astype(np.int64)


def permuted(number: Column, n: int, seed: int) -> Column:
    """Column form of `feistel`; row numbers travel to Python in Arrow batches, nothing else does."""

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(feistel(numbers.to_numpy(np.int64), n, seed))

    return place(number)


def number_rows(df: DataFrame, id_col: str, text_col: str, name: str, hash_col: str | None = None) -> tuple[DataFrame, int]:
    """Adds the global row number 0..n-1 in (id, text hash) order, and returns n.

    Give `hash_col`, a column with the texts' xxhash64, for rows that need not carry their texts through the shuffle.

    One shuffle by ordered bucket, a window inside each bucket, and the sum of the earlier buckets' counts. Only
    those counts (one for some thousands of rows) come to the driver.
    """
    hash_name, bucket_name = own_name(df, "_hash"), own_name(df, "_bucket")
    text_hash = F.col(hash_col) if hash_col else F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    hashed = df.withColumn(hash_name, text_hash)
    bucket, n = ordered_buckets(hashed, id_col, hash_name)
    dealt = hashed.withColumn(bucket_name, bucket)
    counts = dict(dealt.groupBy(bucket_name).count().collect())
    before, offsets = 0, []
    for b in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(b, 0)
    edges = np.array(offsets, dtype=np.int64)

    @F.pandas_udf("long")
    def offset(buckets: pd.Series) -> pd.Series:
        return pd.Series(edges[buckets.to_numpy(np.int64)])

    within = Window.partitionBy(bucket_name).orderBy(F.col(id_col).asc_nulls_first(), hash_name)
    numbered = dealt.withColumn(name, F.row_number().over(within) - 1).withColumn(
        name, F.col(name) + offset(F.col(bucket_name)))
    return numbered.drop(hash_name, bucket_name), n


def shard_rows(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
               hash_col: str | None = None) -> DataFrame:
    """`df` with `shard` (0..shards-1) and `slot` (gapless from 0 in each shard)."""
    number = own_name(df, "_number")
    numbered, n = number_rows(df, id_col, text_col, number, hash_col)
    place = own_name(df, "_place")
    out = numbered.withColumn(place, permuted(F.col(number), n, seed))
    return out.withColumns({"shard": (F.col(place) % shards).cast("int"), "slot": F.expr(f"`{place}` div {shards}")}).drop(number, place)


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Writes the sharded rows as Parquet folders shard=0, shard=1, ..., each file in slot order.

    A shard is cut into ranges of slots, so its files are written by many tasks.
    """
    sharded = shard_rows(df, **options)
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
