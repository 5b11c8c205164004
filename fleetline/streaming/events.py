"""Watermarks, stateful dedup and windows on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.functions import rules
from fleetline.functions.times import window_time

FEED_DELAY = "30 seconds"
ALERT_DELAY = "5 minutes"


def with_feed_watermark(df: DataFrame, ts: str = "event_time", delay: str = FEED_DELAY) -> DataFrame:
    """Event time as a zoned timestamp with the feeds' lateness bound."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def with_alert_watermark(df: DataFrame, ts: str = "arrival_time", delay: str = ALERT_DELAY) -> DataFrame:
    """The same for tables derived from the feeds. Start from a stored table: a query has one watermark per column."""
    return with_feed_watermark(df, ts, delay)


def dedup_first_stream(df: DataFrame, keys: Sequence[str], bounded: bool = True) -> DataFrame:
    """First row to arrive per key. `bounded` forgets a key once the watermark has passed it."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if bounded else df.dropDuplicates(list(keys))


def dedup_last_stream(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Newest row per key so far, ties by the other columns; for update mode into a keyed table.

    Its state holds one row of every key ever seen, so it suits bounded sets of keys; `predictions_stream` resolves the
    newest row in the table instead.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_row"))
    return newest.select(*keys, "_row.*")


def corridor_congestion_stream(buses: DataFrame, window: str = "1 minute", ts: str = "event_time") -> DataFrame:
    """Congestion per route and window of a stream that carries a watermark.

    Two chained aggregations: one state row per (window, route, trip), then the counts of the closed
    windows. No state row ever holds the set of vehicles of a route.
    """
    per_trip = (
        buses.filter(F.col("route_short").isNotNull() & (F.col("route_short") != ""))
        .groupBy(F.window(ts, window).alias("w"), "route_short", "trip_id")
        .agg(F.count_if(F.col("current_status") == "IN_TRANSIT_TO").alias("moving"),
             F.count_if(F.col("current_status") == "STOPPED_AT").alias("stopped"))
    )
    counts = per_trip.groupBy(F.window("w", window).alias("w"), "route_short").agg(
        F.count("trip_id").alias("active_buses"), F.sum("moving").alias("in_transit_buses"),
        F.sum("stopped").alias("stopped_buses"))
    return counts.select(
        "route_short", "active_buses", "in_transit_buses", "stopped_buses",
        rules.congestion_level(F.col("active_buses"), F.col("stopped_buses")).alias("congestion_level"),
        window_time(F.col("w")).cast("timestamp_ntz").alias("window_time"))
