"""Quartile bucket digests: a document fingerprint whose distance follows the difference of two texts.

Every three consecutive bytes of the UTF-8 text are hashed to one of 512 buckets. The quartiles of the 512 counts
turn each count into a two-bit code; the digest is hex text of a length byte (logarithmic, in steps of a tenth), two
quartile-ratio bytes and the 512 codes. Two digests differ by the sum of their code steps, plus small terms for length
and ratios, bounded by `LIMIT`; likeness is one minus the share of that bound.

Defined results: a null text counts as empty; texts of fewer than three bytes have all counts zero, so all codes zero,
and differ by length only (two such texts of one length have equal digests); equal texts have equal digests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.llm.common import LOWEST, ordered_buckets

BUCKETS, BUCKET_BITS = 512, 9
#: Difference at which two texts count as wholly unlike.
LIMIT = 768.0
_MULTIPLIER = np.uint32(0x9E3779B1)


def digest(data: bytes) -> str:
    n = len(data)
    length = 0 if n == 0 else min(255, 1 + int(math.log(n) * 10))
    if n >= 3:
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
        mixed = (raw[:-2] | (raw[1:-1] << np.uint32(8)) | (raw[2:] << np.uint32(16))) * _MULTIPLIER
        counts = np.bincount(mixed >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    else:
        counts = np.zeros(BUCKETS, dtype=np.int64)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] | (codes[:, 1] << 2) | (codes[:, 2] << 4) | (codes[:, 3] << 6)
    ratios = (q1 * 255 // q3, q2 * 255 // q3) if q3 else (0, 0)
    return bytes((length, *ratios)).hex() + packed.tobytes().hex()


def _codes(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, dtype=np.uint8)
    return np.stack([(raw >> s) & 3 for s in (0, 2, 4, 6)]).astype(np.int16)


def difference(a: str, b: str) -> float:
    """0 for equal digests, `LIMIT` at most."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    steps = np.abs(_codes(x[3:]) - _codes(y[3:])).sum()
    header = abs(x[0] - y[0]) + (abs(x[1] - y[1]) + abs(x[2] - y[2])) / 16
    return min(LIMIT, float(steps) + header)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / LIMIT


def digests(df: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """`df` with the digest of each whole text; a column of that name is replaced."""

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(lambda t: digest(t.encode()))

    return df.withColumn(name, of(F.coalesce(F.col(text_col), F.lit(""))))


def digest_and_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its digest, that of its edited text, and likeness to the edited and to the next row's text.

    The next row is that of the next id (equal ids in the order of their text's hash); after the last comes the
    first. The edited text has its last floor(n/2) code points replaced by the first as many of the next text.
    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, into ordered buckets. The first row of each bucket goes to the bucket before it as
    well, so a task sees every neighbour while it holds two texts at a time.
    """
    clean = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = clean.withColumn("hash", F.xxhash64("text"))
    bucket, _ = ordered_buckets(hashed, "id", "hash")
    dealt = hashed.withColumn("bucket", bucket)
    key = F.struct(F.coalesce(F.col("id"), F.lit(LOWEST)).alias("id"), F.col("hash"))
    firsts = sorted((r["bucket"], r["first"]["id"], r["first"]["hash"])
                    for r in dealt.groupBy("bucket").agg(F.min(key).alias("first")).collect())
    before = {(i, h): firsts[k - 1][0] for k, (_, i, h) in enumerate(firsts)}

    @F.pandas_udf("array<long>")
    def places(ids, hashes, buckets):
        import pandas as pd

        return pd.Series([[b, -1 - before[i, h]] if (i, h) in before else [b]
                          for i, h, b in zip(ids, hashes, buckets)])

    spread = dealt.withColumn("place", F.explode(places(F.coalesce("id", F.lit(LOWEST)), "hash", "bucket"))).withColumns({
        "after": F.col("place") < 0, "bucket": F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))})
    ordered = spread.repartition("bucket").sortWithinPartitions(
        "bucket", "after", F.col("id").asc_nulls_first(), "hash").select("bucket", "after", "id", "text")
    schema = (f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return ordered.mapInArrow(lambda batches: _walk(batches, id_col), schema)


def _walk(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, its own in order, then copies of the next bucket's first row."""
    held = None  # bucket, id, text, digest of the row that waits for its successor
    for batch in batches:
        out: list[tuple] = []
        for bucket, after, id_, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held is None and after:
                continue
            mark = digest(text.encode())
            if held is not None and held[0] == bucket:
                out.append(_row(held, text, mark))
            held = None if after else (bucket, id_, text, mark)
        columns = list(zip(*out)) if out else [()] * 7
        types = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=[
            id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _row(held: tuple, next_text: str, next_mark: str) -> tuple:
    _, id_, text, mark = held
    half = len(text) // 2
    edited = (text[:len(text) - half] + next_text[:half]).encode()
    edited_mark = digest(edited)
    return (id_, len(text), hashlib.sha256(edited).hexdigest(), mark, edited_mark,
            likeness(mark, edited_mark), likeness(mark, next_mark))
