"""Congestion kept as rows that merge: counts and sketches of vehicles per route and window.

Distinct vehicles cannot be added up, so hours and days made from exact minutes would have to read all pings again. Here a
row holds a sketch of its vehicles, and rows of one window or of many merge into one. Counts of pings are exact. Distinct
counts are exact for small groups and within 2 percent beyond at the default size. The exact form is `corridor_congestion`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.functions import rules
from fleetline.functions.times import window_time

#: Logarithm of a sketch's registers. A full sketch takes as many bytes, one of few vehicles some bytes each.
BITS = 14
SKETCHES, COUNTS = ("vehicles", "stopped_vehicles"), ("moving", "stopped")


def _flat(rows: DataFrame) -> DataFrame:
    window = F.col("w")
    return rows.select("route_short", window["start"].alias("window_start"), window["end"].alias("window_end"), *SKETCHES, *COUNTS)


def congestion_rollup(buses: DataFrame, window: str = "1 minute", ts: str = "event_time", bits: int = BITS) -> DataFrame:
    """One row for each route and window. Each task sketches its own pings first, so a busy route is no hot key."""
    stopped = F.col("current_status") == "STOPPED_AT"
    named = buses.filter(F.col("route_short").isNotNull() & (F.col("route_short") != ""))
    return _flat(named.groupBy(F.window(ts, window).alias("w"), "route_short").agg(
        F.hll_sketch_agg("trip_id", bits).alias("vehicles"),
        F.hll_sketch_agg(F.when(stopped, F.col("trip_id")), bits).alias("stopped_vehicles"),
        F.count_if(F.col("current_status") == "IN_TRANSIT_TO").alias("moving"), F.count_if(stopped).alias("stopped")))


def widen_rollup(rollup: DataFrame, window: str) -> DataFrame:
    """The rows of wider windows, a multiple of those of `rollup`; rows that share a window are merged."""
    return _flat(rollup.groupBy(F.window("window_start", window).alias("w"), "route_short").agg(
        *[F.hll_union_agg(c).alias(c) for c in SKETCHES], *[F.sum(c).alias(c) for c in COUNTS]))


def rollup_congestion(rollup: DataFrame, distinct_stopped: bool = False) -> DataFrame:
    """The columns of `corridor_congestion` from rows with one window each (`widen_rollup`)."""
    def estimate(sketch: str) -> Column:
        return F.hll_sketch_estimate(sketch)

    counted = rollup.select(
        "route_short", estimate("vehicles").alias("active_buses"), F.col("moving").alias("in_transit_buses"),
        (estimate("stopped_vehicles") if distinct_stopped else F.col("stopped")).alias("stopped_buses"),
        F.struct(F.col("window_end").alias("end")).alias("w"))
    level = rules.congestion_level(F.col("active_buses"), F.col("stopped_buses"))
    return counted.select("route_short", "active_buses", "in_transit_buses", "stopped_buses", level.alias("congestion_level"),
                          window_time(F.col("w")).alias("window_time"))
