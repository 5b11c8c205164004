"""Append and keyed tables, and text outputs.

A keyed table is a folder of change files: every write adds one `change=<n>` folder, reading keeps the
newest row per key. A write costs as much as its batch, never as much as the table. `fold_changes` folds four changes
into one folder, four of those into one, and so on, so that a reader opens a few folders for each power of four changes
and each row is written again once for each; `compact` folds all changes when a scheduled job finds it worthwhile.
Readers list names, choose the folders that together hold every change, and give Spark only those.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetline.operators.dedup import dedup_last

CHANGE = "change"
BUCKET = "bucket"
#: Folders `<first>-<last>` with the newest rows of those changes. Spark does not list folders that start with an underscore.
COMPACTED = "_compacted"
#: Folders of one size that are folded into one of the next.
FOLD = 4
Fold = tuple[int, int]


def bucketed(df: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """Adds `bucket`, the same for all rows of a key."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], n: int = 3) -> None:
    """One folder per bucket. Every task writes into all of them, so `n` does not limit the writers."""
    bucketed(df, keys, n).write.partitionBy(BUCKET).mode("overwrite").parquet(path)


def append_sink(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                trigger: dict | None = None) -> StreamingQuery:
    """A stream appended to files, exactly once per checkpoint."""
    return (df.writeStream.outputMode("append").format(fmt).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start(path))


def write_changes(batch: DataFrame, path: str, change: int, keys: Sequence[str], order: str,
                  ties: Sequence[str] = ()) -> None:
    """Adds one batch to a keyed table. Writing the same change number again replaces it."""
    dedup_last(batch, keys, order, ties).write.mode("overwrite").parquet(f"{path}/{CHANGE}={change}")


def _folder(spark: SparkSession, path: str):
    """A path and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def has_change(spark: SparkSession, path: str, change: int) -> bool:
    """Whether a batch has been written completely."""
    return _complete(spark, f"{path}/{CHANGE}={change}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a keyed table has any change."""
    folder, files = _folder(spark, path)
    return files.exists(folder)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is missing."""
    folder, files = _folder(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def live_folders(changes: Sequence[int], folds: Sequence[Fold], complete: Callable[[Fold], bool]) -> list[int | Fold]:
    """Folds and single changes that together hold every change once, newest first.

    The longest complete fold from the first change on comes last; after it, each change is taken with the longest
    complete fold that holds it.
    """
    base = next((f for f in sorted(folds, key=lambda f: -f[1]) if f[0] == 0 and complete(f)), None)
    first, end = (base[1] + 1 if base else 0), None
    out: list[int | Fold] = []
    for change in sorted((c for c in changes if c >= first), reverse=True):
        if end is not None and change >= end:
            continue
        holding = sorted(f for f in folds if first <= f[0] <= change <= f[1] and (end is None or f[1] < end))
        fold = next((f for f in holding if complete(f)), None)
        out.append(fold or change)
        end = fold[0] if fold else change
    return [*out, base] if base else out


def _fold_path(path: str, fold: Fold) -> str:
    return f"{path}/{COMPACTED}/{fold[0]}-{fold[1]}"


def _complete(spark: SparkSession, folder: str) -> bool:
    marker, files = _folder(spark, f"{folder}/_SUCCESS")
    return files.exists(marker)


def _change_numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in child_names(spark, path) if n.startswith(f"{CHANGE}="))


def _live(spark: SparkSession, path: str) -> list[int | Fold]:
    folds = [(int(a), int(b)) for a, _, b in (n.partition("-") for n in child_names(spark, f"{path}/{COMPACTED}"))]
    return live_folders(_change_numbers(spark, path), folds, lambda f: _complete(spark, _fold_path(path, f)))


def _read_folders(spark: SparkSession, path: str, schema: T.StructType, folders: Sequence[int | Fold]) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(CHANGE, T.LongType())])
    # A fold holds the number of each row's change; of a single change it is the folder's name.
    folds = [_fold_path(path, f) for f in folders if isinstance(f, tuple)]
    single = [f"{path}/{CHANGE}={f}" for f in folders if isinstance(f, int)]
    parts = [spark.read.schema(full).parquet(*folds)] if folds else []
    parts += [spark.read.schema(full).option("basePath", path).parquet(*single)] if single else []
    if not parts:
        return spark.createDataFrame([], full)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def stored_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the folds and changes that a reader needs, with their change number; none of a table without changes."""
    return _read_folders(spark, path, schema, _live(spark, path))


def _latest(changes: DataFrame, keys: Sequence[str], order: str | None, ties: Sequence[str]) -> DataFrame:
    return dedup_last(changes, keys, order, (*ties, CHANGE)) if order else dedup_last(changes, keys, CHANGE)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str],
               order: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Current rows of a keyed table: per key the row of the latest change, or of the highest `order`."""
    return _latest(stored_changes(spark, path, schema), keys, order, ties).drop(CHANGE)


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: str | None = None,
            ties: Sequence[str] = (), keep: Column | None = None, before: int | None = None) -> None:
    """Folds all complete changes into one folder of the table, from which later reads start.

    `keep` leaves out rows that are no longer needed, `before` the changes from that number on.
    Use the order of the readers. Readers that started before go on with the changes, which stay where they are.
    """
    upto = next((n for n in reversed(_change_numbers(spark, path)) if (before is None or n < before) and has_change(spark, path, n)), None)
    if upto is not None:
        changes = stored_changes(spark, path, schema).filter(F.col(CHANGE) <= upto)
        latest = _latest(changes, keys, order, ties)
        (latest if keep is None else latest.filter(keep)).write.mode("overwrite").parquet(_fold_path(path, (0, upto)))


def fold_changes(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], before: int,
                 order: str | None = None, ties: Sequence[str] = ()) -> None:
    """Folds the last four, 16, 64, ... changes before number `before` that start at a multiple of their count.

    Changes from `before` on may still be written or replayed and stay out. Use the schema and the order of the readers.
    Called before each change, it leaves readers at most three folders for each power of four changes.
    """
    count = FOLD
    while count <= before:
        last = before // count * count - 1
        fold = (last - count + 1, last)
        count *= FOLD
        if _complete(spark, _fold_path(path, fold)):
            continue
        spans = [(f, f if isinstance(f, tuple) else (f, f)) for f in _live(spark, path)]
        met = [(f, span) for f, span in spans if span[0] <= fold[1] and span[1] >= fold[0]]
        # A longer fold, or one that only meets these changes in part, serves the readers already.
        if len(met) > 1 and all(fold[0] <= a and b <= fold[1] for _, (a, b) in met):
            rows = _read_folders(spark, path, schema, [f for f, _ in met])
            _latest(rows, keys, order, ties).write.mode("overwrite").parquet(_fold_path(path, fold))


def upsert_sink(df: DataFrame, keys: Sequence[str], order: str, path: str, checkpoint: str,
                ties: Sequence[str] = (), output_mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """A stream into a keyed table; later batches replace earlier rows of the same key."""
    schema = df.schema

    def add(batch: DataFrame, number: int) -> None:
        fold_changes(batch.sparkSession, path, schema, keys, number, order, ties)
        write_changes(batch, path, number, keys, order, ties)

    return (df.writeStream.outputMode(output_mode).foreachBatch(add)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def decision_outbox(decisions: DataFrame, name: str = "payload") -> DataFrame:
    """One JSON document per decision."""
    return decisions.select(F.to_json(F.struct(*decisions.columns)).alias(name))


def write_outbox(decisions: DataFrame, path: str) -> None:
    decision_outbox(decisions, "value").write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str, column: str = "feature") -> None:
    """One GeoJSON feature collection per line."""
    line = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col(column), F.lit("]}"))
    features.select(line.alias("value")).write.mode("overwrite").text(path)
