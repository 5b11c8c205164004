"""Feed entities to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.functions.ids import agency_selected, base_id, blank_to, direction, route_short
from fleetline.functions.rules import status_name
from fleetline.functions.times import from_epoch_ms
from fleetline.operators.enrich import with_stop_info


def _present(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def _unless_zero(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(0).cast("bigint"))


def _feed_seconds() -> Column:
    """The feed's own time, else the time of the run."""
    return F.coalesce(_unless_zero("feed_ts"), F.unix_seconds(F.current_timestamp()))


def _event_time() -> Column:
    """The vehicle's own timestamp when it has one, else the feed's."""
    return from_epoch_ms(F.coalesce(_unless_zero("vehicle.timestamp"), _feed_seconds()) * 1000)


def flatten_vehicles(feed: DataFrame, stops: DataFrame) -> DataFrame:
    """Train positions with stop details; entities without trip or route are skipped."""
    kept = feed.filter(_present("vehicle.trip.trip_id") & _present("vehicle.trip.route_id"))
    stop = F.coalesce(F.col("vehicle.stop_id"), F.lit(""))
    flat = kept.select(
        F.col("vehicle.trip.trip_id").alias("trip_id"), F.col("vehicle.trip.route_id").alias("route_id"),
        direction(stop, F.col("vehicle.trip.trip_id")).alias("direction"), stop.alias("stop_id"),
        base_id(stop).alias("stop_base"), status_name(F.col("vehicle.current_status")).alias("current_status"),
        F.coalesce(F.col("vehicle.current_stop_sequence"), F.lit(0)).alias("stop_sequence"),
        _event_time().alias("event_time"))
    return with_stop_info(flat, stops).select(
        "trip_id", "route_id", "direction", "stop_id", "stop_base", "stop_name", "stop_lat", "stop_lon",
        "current_status", "stop_sequence", "event_time")


def flatten_trip_updates(feed: DataFrame, stops: DataFrame) -> DataFrame:
    """One row per stop prediction; no stop, or neither arrival nor departure, means no row."""
    trip = "trip_update.trip"
    kept = feed.filter(_present(f"{trip}.trip_id") & _present(f"{trip}.route_id"))
    each = kept.select(_feed_seconds().alias("feed_seconds"), F.col(trip).alias("t"), F.explode("trip_update.stop_time_update").alias("u"))
    none = F.lit(0).cast("bigint")
    flat = each.select(
        "t.trip_id", "t.route_id", direction(F.col("u.stop_id"), F.col("t.trip_id")).alias("direction"),
        F.col("u.stop_id").alias("stop_id"), base_id(F.col("u.stop_id")).alias("stop_base"),
        F.coalesce("u.arrival", none).alias("arrival_epoch"),
        F.coalesce("u.departure", none).alias("departure_epoch"),
        from_epoch_ms(F.col("feed_seconds") * 1000).alias("event_time"))
    usable = flat.filter(_present("stop_id") & ((F.col("arrival_epoch") != 0) | (F.col("departure_epoch") != 0)))
    return with_stop_info(usable, stops).select(
        "trip_id", "route_id", "direction", "stop_id", "stop_base", "stop_name", "stop_lat", "stop_lon",
        "arrival_epoch", "departure_epoch", "event_time")


def flatten_buses(feed: DataFrame, agencies: str = "all") -> DataFrame:
    """Bus positions; a route and non-zero coordinates are required."""
    v = "vehicle"
    kept = feed.filter(
        F.col(v).isNotNull() & agency_selected(F.col(f"{v}.vehicle_id"), agencies)
        & _present(f"{v}.trip.route_id") & (F.col(f"{v}.position.latitude") != 0)
        & (F.col(f"{v}.position.longitude") != 0))
    route = F.col(f"{v}.trip.route_id")
    made_up = F.concat(route, F.lit(":"), F.coalesce(F.col(f"{v}.vehicle_id"), F.lit("")))
    return kept.select(
        blank_to(F.col(f"{v}.trip.trip_id"), made_up).alias("trip_id"), route.alias("route_id"),
        route_short(route).alias("route_short"),
        F.coalesce(F.col(f"{v}.trip.direction_id").cast("string"), F.lit("")).alias("direction"),
        F.coalesce(F.col(f"{v}.stop_id"), F.lit("")).alias("stop_id"),
        F.col(f"{v}.position.latitude").alias("vehicle_lat"),
        F.col(f"{v}.position.longitude").alias("vehicle_lon"),
        F.coalesce(f"{v}.position.bearing", F.lit(-1.0)).alias("bearing"),
        status_name(F.col(f"{v}.current_status")).alias("current_status"), _event_time().alias("event_time"))
