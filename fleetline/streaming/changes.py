"""Change logs and mergeable rows of streams, by closed stretches of event time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetline.functions.times import duration_seconds
from fleetline.operators.dedup import dedup_last, top_per_group
from fleetline.operators.models import anomaly_alerts, trend_forecasts
from fleetline.operators.rollup import congestion_rollup
from fleetline.operators.sequence import STOP_KEYS
from fleetline.sinks.tables import CHANGE, compact, exists, fold_changes, stored_changes
from fleetline.streaming.events import ALERT_DELAY, FEED_DELAY
from fleetline.streaming.headways import FORECASTS, HEADWAYS
from fleetline.streaming.slices import WIDTH, Closed, Side, closed_slices, micros, read_closed, write_closed

#: Batches after which a change log's newest rows are folded, and settled keys leave what is searched.
FOLD_EVERY = 16
AT, BEFORE, AFTER, WEIGHT = "at", "before", "after", "weight"
RING = T.StructType([*HEADWAYS.fields, T.StructField("rank", T.LongType())])
ANOMALIES = T.StructType([f for f in HEADWAYS.fields if f.name != "arrival_time"] + [
    T.StructField("alert_type", T.StringType()), T.StructField("severity", T.StringType()), HEADWAYS["arrival_time"]])


def log_schema(schema: T.StructType, keys: Sequence[str]) -> T.StructType:
    image = T.StructType([f for f in schema if f.name not in keys])
    return T.StructType([*[schema[k] for k in keys], T.StructField(AT, T.LongType()), T.StructField(BEFORE, image),
                         T.StructField(AFTER, image)])


def _kept(spark: SparkSession, path: str, schema: T.StructType, number: int) -> DataFrame:
    """Rows of changes before `number`; what an unfinished run of it wrote is not read."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(CHANGE, T.LongType())]))
    return stored_changes(spark, path, schema).filter(F.col(CHANGE) < number)


def _of_keys(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    listed = wanted.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return rows.join(listed, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_semi")


def change_log_stream(rows: DataFrame, keys: Sequence[str], ts: str, path: str, checkpoint: str, ties: Sequence[str] = (),
                      horizon: str = "2 days", delay: str = FEED_DELAY, width: str = WIDTH, trigger: dict | None = None) -> StreamingQuery:
    """The newest row of each key as a log of changes, in `path`/log: keys, and the other columns before and after.

    Each closed stretch adds a row for each key it has; `before` is null for a new key. Sums over the newest rows follow from
    the log alone (`weighted_images`). After a pause longer than `horizon` a key is settled: its newest row stays in the sums,
    what comes later counts beside it like another key's, and only keys that are not settled are searched. How the stream is
    cut into batches does not matter.
    """
    schema, horizon_us = log_schema(rows.schema, keys), duration_seconds(horizon) * 1_000_000
    log, image = f"{path}/log", [c for c in rows.columns if c not in keys]

    def work(closed: Closed) -> None:
        spark, number, oldest = closed.spark, closed.number, closed.before - horizon_us
        if number % FOLD_EVERY == 0 and exists(spark, log):
            compact(spark, log, schema, keys, AT, keep=F.col(AT) >= oldest, before=number)
        new = _spells(closed.due["rows"], keys, ts, ties, image, horizon_us)
        old = dedup_last(_of_keys(_kept(spark, log, schema, number).filter(F.col(AT) >= oldest), new, keys), keys, AT)
        old = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(AT).alias("_at"), F.col(AFTER).alias(BEFORE))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        follows = same & (F.col("spell") == 1) & (F.col("first") - F.col("_at") <= horizon_us)
        write_closed(new.join(old, follows, "left").select(*schema.names), log, number)

    return closed_slices({"rows": Side(rows, micros(ts), delay)}, path, checkpoint, work, width=width, trigger=trigger)


def _spells(rows: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], image: Sequence[str], horizon_us: int) -> DataFrame:
    """The newest row of each key and spell, a run of rows without a pause longer than the horizon, and the spell's first time.

    No pause fits into a slice as wide as the horizon, so rows are reduced to those before spells are told apart.
    """
    parts = rows.groupBy(*keys, F.floor(micros(ts) / F.lit(horizon_us)).alias("part")).agg(
        F.min(micros(ts)).alias("first"), F.max(micros(ts)).alias(AT), F.max_by(F.struct(*image), F.struct(ts, *ties)).alias(AFTER))
    in_order = Window.partitionBy(*keys).orderBy("part")
    pause = F.col("first") - F.lag(AT).over(in_order) > horizon_us
    begun = parts.withColumn("begins", F.coalesce(pause, F.lit(True)))
    spells = begun.withColumns({
        "spell": F.count_if("begins").over(in_order), "ends": F.coalesce(F.lead("begins").over(in_order), F.lit(True)),
        "first": F.max(F.when(F.col("begins"), F.col("first"))).over(in_order)})
    return spells.filter("ends").select(*keys, "spell", "first", AT, AFTER)


def read_change_log(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """All changes of a log of rows with `schema`."""
    return read_closed(spark, f"{path}/log", log_schema(schema, keys))


def weighted_images(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row that came with weight 1 and each row it replaced with weight -1: sums of weights are counts of newest rows."""
    both = F.array(F.struct(F.col(AFTER).alias("row"), F.lit(1).alias(WEIGHT)), F.struct(F.col(BEFORE).alias("row"), F.lit(-1).alias(WEIGHT)))
    return log.select(*keys, F.inline(both)).filter("row IS NOT NULL").select(*keys, "row.*", WEIGHT)


def sums_of_log(log: DataFrame, keys: Sequence[str], by: Sequence[str], sums: Sequence[str] = (), count: str = "n") -> DataFrame:
    """Number and sums of the newest rows for each value of `by`; groups that all rows have left are not returned."""
    weight = F.col(WEIGHT)
    return weighted_images(log, keys).groupBy(*by).agg(
        F.sum(weight).alias(count), *[F.sum(weight * F.col(c)).alias(c) for c in sums]).filter(F.col(count) != 0)


def congestion_rollup_stream(buses: DataFrame, path: str, checkpoint: str, window: str = "1 minute", ts: str = "event_time",
                             delay: str = FEED_DELAY, width: str = WIDTH, trigger: dict | None = None) -> StreamingQuery:
    """Rows of `congestion_rollup` for each closed stretch, in `path`/rollup. Stretches may share a window: merge when reading."""
    def work(closed: Closed) -> None:
        write_closed(congestion_rollup(closed.due["buses"], window, ts), f"{path}/rollup", closed.number)

    return closed_slices({"buses": Side(buses, micros(ts), delay)}, path, checkpoint, work, width=width, trigger=trigger)


def read_rollup(spark: SparkSession, path: str, buses: T.StructType) -> DataFrame:
    """Rows of the rollup of a stream with schema `buses`, for `widen_rollup`."""
    return read_closed(spark, f"{path}/rollup", congestion_rollup(spark.createDataFrame([], buses)).schema)


def model_stream(headways: DataFrame, path: str, checkpoint: str, max_n: int = 100, delay: str = ALERT_DELAY, width: str = WIDTH,
                 trigger: dict | None = None, **options) -> StreamingQuery:
    """Streaming form of `anomaly_alerts` and `trend_forecasts`, in `path`/anomalies and `path`/trends.

    Between stretches a keyed table holds the last `max_n` headways of each stop, as a ring by rank; a stretch reads and
    writes those of its own stops.
    """
    place = (*STOP_KEYS, "rank")

    def work(closed: Closed) -> None:
        spark, number = closed.spark, closed.number
        fold_changes(spark, f"{path}/ring", RING, place, number)
        new = closed.due["headways"].select(*HEADWAYS.names)
        old = top_per_group(_of_keys(_kept(spark, f"{path}/ring", RING, number), new, STOP_KEYS), place, [F.col(CHANGE).desc()], 1)
        both = new.unionByName(old.select(*HEADWAYS.names))
        fresh = micros("arrival_time") > closed.before
        for found, name in ((anomaly_alerts(both, max_n=max_n, **options), "anomalies"),
                            (trend_forecasts(both, max_n=max_n, **options), "trends")):
            write_closed(found.filter(fresh), f"{path}/{name}", number)
        newest = [F.col("arrival_time").desc(), F.col("curr_trip").desc()]
        write_closed(top_per_group(both, STOP_KEYS, newest, max_n, rank="rank").select(*RING.names), f"{path}/ring", number)

    return closed_slices({"headways": Side(headways, micros("arrival_time"), delay)}, path, checkpoint, work, width=width, trigger=trigger)


def read_anomalies(spark: SparkSession, path: str) -> DataFrame:
    return read_closed(spark, f"{path}/anomalies", ANOMALIES)


def read_trends(spark: SparkSession, path: str) -> DataFrame:
    return read_closed(spark, f"{path}/trends", FORECASTS)
