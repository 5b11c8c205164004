"""Running streams to the end of what is available, and streams with keyed results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetline.operators.agent import Responder, dispatcher_decisions
from fleetline.operators.dedup import ALERT_IDENTITY
from fleetline.plans.jobs import STOP_COLUMNS, within_eta
from fleetline.schemas import TRIP_UPDATES
from fleetline.session import new_run_dir
from fleetline.sinks.tables import CHANGE, append_sink, decision_outbox, exists, fold_changes, has_change
from fleetline.sinks.tables import read_keyed, stored_changes, upsert_sink
from fleetline.streaming.events import dedup_first_stream

PREDICTION_COLUMNS = (*STOP_COLUMNS, "arrival_epoch", "event_time")


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def closed(stream: DataFrame, **last) -> DataFrame:
    """`stream` with one more row, `last`, to close it: its late time moves the watermark past all other rows.

    Give the time column, and whatever the filters behind the watermark ask for; other columns are null. Without such a
    row a run that ends keeps the rows above its last watermark back for the run that resumes it.
    """
    spark, path = stream.sparkSession, new_run_dir(stream.sparkSession, "closing")
    write_last(spark, stream.schema, path, **last)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def write_last(spark: SparkSession, schema: T.StructType, path: str, **last) -> None:
    """A file with one row of the given values, other columns null."""
    spark.range(1).select(*[F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(path)


def run_append(df: DataFrame, label: str = "stream") -> DataFrame:
    """Runs an append stream over the data present and returns the files it wrote as a table."""
    base = new_run_dir(df.sparkSession, label)
    finish(append_sink(df, f"{base}/data", f"{base}/checkpoint"))
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/data")


def run_upsert(df: DataFrame, keys: Sequence[str], order: str, label: str = "keyed",
               ties: Sequence[str] = (), output_mode: str = "append") -> DataFrame:
    """Runs a stream into a keyed table and returns its current rows."""
    base = new_run_dir(df.sparkSession, label)
    finish(upsert_sink(df, keys, order, f"{base}/data", f"{base}/checkpoint", ties, output_mode))
    return read_keyed(df.sparkSession, f"{base}/data", df.schema, keys, order, ties)


PREDICTION_KEYS = ("trip_id", "stop_id")


def predictions_stream(trip_updates: DataFrame, path: str, checkpoint: str,
                       trigger: dict | None = None) -> StreamingQuery:
    """Latest predictions as a keyed table. Etas are left out, since they change with the time of reading."""
    usable = trip_updates.filter("arrival_epoch > 0").select(*PREDICTION_COLUMNS)
    return upsert_sink(usable, PREDICTION_KEYS, "event_time", path, checkpoint, ("arrival_epoch",), trigger=trigger)


def read_arrival_estimates(spark: SparkSession, path: str, as_of, low: int = -30, high: int = 1800) -> DataFrame:
    """Arrival estimates at `as_of`. A prediction that has moved out of range hides its older ones."""
    schema = T.StructType([TRIP_UPDATES[c] for c in PREDICTION_COLUMNS])
    latest = read_keyed(spark, path, schema, PREDICTION_KEYS, "event_time", ("arrival_epoch",))
    return within_eta(latest, as_of, low, high)


def dispatcher_stream(alerts: DataFrame, path: str, checkpoint: str, responder: Responder | None = None,
                      bounded: bool = True, trigger: dict | None = None, outbox: str | None = None) -> StreamingQuery:
    """Decisions for a stream of alerts with a watermark, as a keyed table at `path`.

    With `outbox`, each batch's decisions are delivered there as they are made, one JSON document a line; a batch that
    is replayed delivers the same documents to the same folder.

    Each alert identity reaches the responder once, for good: alerts whose identity the table already has are left
    out by a join on the key columns alone. A batch that is replayed after a failure keeps the answers written.
    """
    identity = T.StructType([alerts.schema[c] for c in ALERT_IDENTITY])

    def decide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not has_change(spark, path, number):
            answer(spark, batch, number)
        if outbox and not has_change(spark, outbox, number):
            made = spark.read.parquet(f"{path}/{CHANGE}={number}")
            decision_outbox(made, "value").write.mode("overwrite").text(f"{outbox}/{CHANGE}={number}")

    def answer(spark: SparkSession, batch: DataFrame, number: int) -> None:
        fold_changes(spark, path, dispatcher_decisions(batch, responder).schema, ALERT_IDENTITY, number)
        if exists(spark, path):
            known = stored_changes(spark, path, identity).select(*[F.col(c).alias(f"_{c}") for c in ALERT_IDENTITY])
            same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ALERT_IDENTITY])
            batch = batch.join(known, same, "left_anti")
        # Already one row for each identity.
        dispatcher_decisions(batch, responder).write.mode("overwrite").parquet(f"{path}/{CHANGE}={number}")

    return (dedup_first_stream(alerts, ALERT_IDENTITY, bounded).writeStream.foreachBatch(decide)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
