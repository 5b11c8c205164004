"""First arrivals, headways and forecasts on an out-of-order stream, by closed stretches of event time.

A stretch's stopped vehicles become arrivals, are matched with the last arrivals before the stretch by the operator of
tables, and written. Between stretches two keyed tables hold what is needed: when each trip last counted at each stop, as far
back as the horizon, and the last two arrivals of each stop. Rows later than the bound are dropped, never inserted behind a
headway that was written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetline.functions.times import duration_seconds, time_slice
from fleetline.operators.dedup import top_per_group
from fleetline.operators.sequence import STOP_KEYS, headway, headway_forecast
from fleetline.plans.jobs import STOP_COLUMNS
from fleetline.schemas import struct
from fleetline.sinks.tables import CHANGE, compact, exists, stored_changes
from fleetline.streaming.events import FEED_DELAY
from fleetline.streaming.slices import WIDTH, Closed, Side, closed_slices, micros, read_closed, write_closed

#: Several pings of a trip at a stop within it count as the first of them.
RESOLUTION = 60
#: Batches after which the keyed tables are folded.
FOLD_EVERY = 32
VISIT = ("trip_id", "stop_id")
SEEN = struct(trip_id="string", stop_id="string", counted="long")
ARRIVALS = struct(trip_id="string", route_id="string", direction="string", stop_id="string", stop_name="string", stop_lat="double",
                  stop_lon="double", event_time="time")
TAILS = T.StructType([*ARRIVALS.fields, T.StructField("rank", T.LongType())])
HEADWAYS = struct(route_id="string", direction="string", stop_id="string", stop_name="string", stop_lat="double", stop_lon="double",
                  prev_trip="string", curr_trip="string", headway_seconds="long", arrival_time="time")
FORECASTS = struct(route_id="string", direction="string", stop_id="string", stop_name="string", stop_lat="double", stop_lon="double",
                   curr_trip="string", headway_seconds="long", prev_headway_seconds="long", predicted_headway="long",
                   forecast_type="string", arrival_time="time")


def _before(spark: SparkSession, path: str, schema: T.StructType, number: int) -> DataFrame:
    """Rows that batches before `number` left in a keyed table; what an unfinished run of it wrote is not read."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(CHANGE, T.LongType())]))
    return stored_changes(spark, path, schema).filter(F.col(CHANGE) < number)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    return reduce(and_, [a[k].eqNullSafe(b[k]) for k in keys])


def _counted(stopped: DataFrame, seen: DataFrame, horizon_us: int) -> DataFrame:
    """The first arrival of each trip at each stop, and the first after each horizon since one that counted."""
    row = F.struct(micros("event_time").alias("at"), "route_id", "direction", "stop_name", "stop_lat", "stop_lon",
                   F.col("event_time").cast("timestamp_ntz").alias("event_time"))
    visits = stopped.groupBy(*VISIT, time_slice("event_time", RESOLUTION).alias("_slice")).agg(F.min(row).alias("visit"))
    visits = visits.groupBy(*VISIT).agg(F.array_sort(F.collect_list("visit")).alias("visits"))
    last = seen.groupBy(*VISIT).agg(F.max("counted").alias("counted"))
    met = visits.join(last, _same(visits, last, VISIT), "left").select(visits["trip_id"], visits["stop_id"], "visits", "counted")
    none = F.filter("visits", lambda _: F.lit(False))
    kept = F.aggregate("visits", F.struct(F.col("counted").alias("last"), none.alias("kept")), lambda done, v: F.when(
        done["last"].isNull() | (v["at"] - done["last"] > horizon_us),
        F.struct(v["at"].alias("last"), F.concat(done["kept"], F.array(v)).alias("kept"))).otherwise(done))
    return met.select(*VISIT, F.explode(kept["kept"]).alias("v")).select(*VISIT, "v.*").select(*ARRIVALS.names)


def headway_stream(positions: DataFrame, path: str, checkpoint: str, delay: str = FEED_DELAY, horizon: str = "2 days",
                   width: str = WIDTH, trigger: dict | None = None) -> StreamingQuery:
    """Arrivals, headways and forecasts of a stream of vehicle positions, as tables below `path`.

    A trip counts once per stop within `horizon`, at the resolution of a minute.
    """
    horizon_us = duration_seconds(horizon) * 1_000_000

    def work(closed: Closed) -> None:
        spark, number = closed.spark, closed.number
        if number % FOLD_EVERY == 0:
            fold(spark, path, closed.before - horizon_us, number)
        stopped = closed.due["positions"].filter((F.col("current_status") == "STOPPED_AT") & F.col("trip_id").isNotNull())
        seen = _before(spark, f"{path}/seen", SEEN, number).filter(F.col("counted") >= closed.before - horizon_us)
        write_closed(_counted(stopped, seen, horizon_us), f"{path}/arrivals", number)
        new = spark.read.schema(ARRIVALS).parquet(f"{path}/arrivals/{CHANGE}={number}")
        write_closed(new.groupBy(*VISIT).agg(F.max(micros("event_time")).alias("counted")), f"{path}/seen", number)
        old = top_per_group(_before(spark, f"{path}/tails", TAILS, number), (*STOP_KEYS, "rank"), [F.col(CHANGE).desc()], 1)
        stops = new.select(*STOP_KEYS).distinct()
        old = old.join(stops, _same(old, stops, STOP_KEYS), "left_semi")
        both = new.withColumn("fresh", F.lit(True)).unionByName(old.select(*ARRIVALS.names, F.lit(False).alias("fresh")))
        for found, name, kind in ((headway(both, also=("fresh",)), "headways", HEADWAYS),
                                  (headway_forecast(both, also=("fresh",)), "forecasts", FORECASTS)):
            write_closed(found.filter("fresh").select(*kind.names), f"{path}/{name}", number)
        newest = [F.col("event_time").desc(), F.col("trip_id").desc()]
        write_closed(top_per_group(both, STOP_KEYS, newest, 2, rank="rank").select(*TAILS.names), f"{path}/tails", number)

    return closed_slices({"positions": Side(positions, micros("event_time"), delay)}, path, checkpoint, work, width=width, trigger=trigger)


def fold(spark: SparkSession, path: str, oldest: int, number: int) -> None:
    """Folds the keyed tables of the batches before `number`; trips that last counted before `oldest` are forgotten."""
    for name, schema, keys, keep in (("seen", SEEN, VISIT, F.col("counted") >= oldest), ("tails", TAILS, (*STOP_KEYS, "rank"), None)):
        if exists(spark, f"{path}/{name}"):
            compact(spark, f"{path}/{name}", schema, keys, keep=keep, before=number)


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    return read_closed(spark, f"{path}/arrivals", ARRIVALS)


def read_headways(spark: SparkSession, path: str) -> DataFrame:
    return read_closed(spark, f"{path}/headways", HEADWAYS)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    return read_closed(spark, f"{path}/forecasts", FORECASTS)
