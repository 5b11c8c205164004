"""Grouped summaries. Each one pre-aggregates before its shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.functions import rules
from fleetline.functions.ids import blank_to
from fleetline.functions.times import as_epoch, instant, window_time
from fleetline.operators.dedup import top_per_group


def corridor_congestion(buses: DataFrame, window: str = "1 minute", ts: str = "event_time",
                        distinct_stopped: bool = False) -> DataFrame:
    """Distinct vehicles, moving and stopped pings and a congestion level per route and window.

    Pings are first reduced to one row per (window, route, trip), so a busy route is spread over its
    trips. `distinct_stopped` counts stopped vehicles instead of stopped pings.
    """
    per_trip = (
        buses.filter(F.col("route_short").isNotNull() & (F.col("route_short") != ""))
        .groupBy(F.window(ts, window).alias("w"), "route_short", "trip_id")
        .agg(F.count_if(F.col("current_status") == "IN_TRANSIT_TO").alias("moving"),
             F.count_if(F.col("current_status") == "STOPPED_AT").alias("stopped"))
    )
    stopped = F.count_if((F.col("stopped") > 0) & F.col("trip_id").isNotNull()) if distinct_stopped else F.sum("stopped")
    return (
        per_trip.groupBy("w", "route_short")
        .agg(F.count("trip_id").alias("active_buses"), F.sum("moving").alias("in_transit_buses"),
             stopped.alias("stopped_buses"))
        .select("route_short", "active_buses", "in_transit_buses", "stopped_buses",
                rules.congestion_level(F.col("active_buses"), F.col("stopped_buses")).alias("congestion_level"),
                window_time(F.col("w")).alias("window_time"))
    )


def fleet_counts(vehicles: DataFrame, alerts: DataFrame, surges: DataFrame) -> DataFrame:
    """One row: vehicles per mode, live routes, all rows of `alerts`, and crowded stations."""
    fleet = vehicles.agg(
        F.count_if(F.col("mode") == "subway").alias("trains"),
        F.count_if(F.col("mode") == "bus").alias("buses"),
        F.countDistinct(F.nullif(F.col("route_short"), F.lit(""))).alias("routes"))
    alert_rows = alerts.agg(F.count(F.lit(1)).alias("alerts"))
    surge_rows = surges.agg(F.count_if(F.col("crowd_level").isin("SURGE", "HIGH")).alias("crowd_surges"))
    names = ("trains", "buses", "routes", "alerts", "crowd_surges")
    merged = fleet.unionByName(alert_rows, allowMissingColumns=True).unionByName(
        surge_rows, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in names])


def top_routes(vehicles: DataFrame, k_by_mode: Mapping[str, int] | None = None) -> DataFrame:
    """Busiest routes per mode with their rank."""
    limits = dict(k_by_mode or {"subway": 15, "bus": 20})
    counts = (
        vehicles.filter(F.col("mode").isin(*limits) & (F.col("route_short") != ""))
        .groupBy("mode", "route_short").agg(F.count(F.lit(1)).alias("vehicles"))
    )
    ranked = top_per_group(counts, ["mode"], [F.col("vehicles").desc(), "route_short"],
                           max(limits.values()), rank="position")
    keep = F.lit(False)
    for mode, k in limits.items():
        keep = keep | ((F.col("mode") == mode) & (F.col("position") <= k))
    return ranked.filter(keep)


def known_routes(vehicles: DataFrame) -> DataFrame:
    """Distinct routes per mode with a sort key that orders numbers by value (M4 before M15)."""
    name = blank_to(F.col("route_short"), F.col("route_id"))
    mode = F.when(F.col("mode") == "bus", "bus").otherwise("subway")
    placed = vehicles.filter((F.col("lat") != 0) & (F.col("lon") != 0))
    number = F.regexp_extract("route", r"(\d+)", 1)
    key = F.concat(F.regexp_extract("route", r"^(\D*)", 1), F.lpad(number, 12, "0"),
                   F.regexp_extract("route", r"^\D*\d*(.*)$", 1))
    return (
        placed.select(mode.alias("mode"), name.alias("route")).filter("route <> ''").distinct()
        .withColumn("sort_key", key)
    )


def feed_stats(feed: DataFrame) -> DataFrame:
    """Entities, vehicles and trip updates per feed; the row without a feed is the grand total."""
    return feed.rollup("feed").agg(
        F.count(F.lit(1)).alias("entities"),
        F.count("vehicle").alias("vehicle_positions"),
        F.count("trip_update").alias("trip_updates"))


def is_live(frames: Mapping[str, tuple[DataFrame, str]], as_of, within: int = 30) -> DataFrame:
    """One row saying whether any table has a record newer than `within` seconds before `as_of`.

    `frames` maps a table name to (table, time column).
    """
    now = as_epoch(as_of)
    parts = []
    for df, ts in frames.values():
        recent = (F.col(ts) > instant(df, ts, now - within)) & (F.col(ts) <= instant(df, ts, now))
        parts.append(df.filter(recent).agg((F.count(F.lit(1)) > 0).alias("live")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.agg(F.max("live").alias("live"))
