"""Joins that add context to alerts, forecasts and vehicles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.functions import rules
from fleetline.functions.ids import base_id
from fleetline.functions.times import from_epoch_ms
from fleetline.operators.asof import asof_join
from fleetline.operators.dedup import dedup_last


def weather_impact(alerts: DataFrame, weather: DataFrame, tolerance: str | int = "30 minutes",
                   observed: str = "event_time", width: str | int | None = None) -> DataFrame:
    """Each alert with the newest weather observation at or before it, while that is still fresh."""
    now = F.col("current")
    readings = weather.select(
        F.col(observed).alias("_observed"), now["temperature_2m"].alias("_temp"),
        now["precipitation"].alias("_rain"), now["wind_speed_10m"].alias("_wind"),
        now["weather_code"].alias("_code"))
    joined = asof_join(alerts, readings, "arrival_time", "_observed", tolerance,
                       ties=("_code", "_temp", "_rain", "_wind"), width=width)
    return joined.select(
        "route_id", "direction", "stop_name", "alert_type", "severity", "headway_seconds",
        F.coalesce("_temp", F.lit(18.0)).alias("temperature_c"),
        F.coalesce("_rain", F.lit(0.0)).alias("precipitation_mm"),
        F.coalesce("_wind", F.lit(5.0)).alias("wind_speed_kmh"),
        rules.weather_condition(F.col("_code")).alias("weather_condition"),
        rules.weather_risk(F.col("_rain"), F.col("_wind")).alias("weather_risk_level"),
        "arrival_time",
    )


def surge_line(line: Column) -> Column:
    """Route id behind a line code: everything after the first letter."""
    return F.substring(line, F.lit(2), F.length(line))


def station_bottlenecks(alerts: DataFrame, surges: DataFrame, within: str | int = "180 seconds",
                        width: str | int | None = None) -> DataFrame:
    """Alerts with every crowded station of their line.

    A station counts when its newest reading at the time of the alert is at most `within` old and says
    HIGH or SURGE, the same rule the live surge snapshot uses.
    """
    readings = surges.select(
        surge_line(F.col("line")).alias("route_id"), F.col("station_id").alias("_station"),
        F.col("station_name").alias("_name"), F.col("crowd_level").alias("_crowd"),
        F.col("taps_per_minute").alias("_taps"), from_epoch_ms(F.col("event_time")).alias("_seen"))
    joined = asof_join(alerts, readings, "arrival_time", "_seen", within,
                       keys=("route_id",), entity=("_station",), ties=("_taps", "_crowd"), width=width)
    crowd, kind = F.col("_crowd"), F.col("alert_type")
    return joined.filter(crowd.isin("HIGH", "SURGE")).select(
        F.col("_name").alias("station_name"), F.col("route_id").alias("subway_line"),
        crowd.alias("crowd_level"), F.col("_taps").alias("taps_per_minute"), "alert_type",
        "headway_seconds",
        rules.bottleneck_severity(crowd, kind, F.col("severity")).alias("bottleneck_severity"),
        rules.bottleneck_recommendation(crowd, kind).alias("dispatcher_recommendation"),
        F.col("arrival_time").alias("detection_time"),
    )


def with_stop_info(df: DataFrame, stops: DataFrame, stop: str = "stop_id") -> DataFrame:
    """Stop name and position by exact id, else by the id without its direction letter, else blank.

    The stop side is broadcast only when its size is below the session's threshold.
    """
    exact = stops.select(F.col("stop_id").alias("_exact"), F.struct("stop_name", "stop_lat", "stop_lon").alias("_hit"))
    base = stops.select(F.col("stop_id").alias("_base"), F.struct("stop_name", "stop_lat", "stop_lon").alias("_near"))
    hit = F.coalesce("_hit", "_near")
    return (
        df.join(exact, F.col(stop) == F.col("_exact"), "left")
        .join(base, base_id(F.col(stop)) == F.col("_base"), "left")
        .select(*df.columns,
                F.coalesce(hit["stop_name"], F.lit("")).alias("stop_name"),
                F.coalesce(hit["stop_lat"], F.lit(0.0)).alias("stop_lat"),
                F.coalesce(hit["stop_lon"], F.lit(0.0)).alias("stop_lon"))
    )


def _anchored(df: DataFrame, vehicles: DataFrame, seen: str | None) -> DataFrame:
    """Own coordinates when both are set, else the vehicle's; rows with neither are dropped."""
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("lat") != 0) & (F.col("lon") != 0)
    placed = vehicles.filter(F.col("trip_id").isNotNull())
    if seen:
        placed = dedup_last(placed, ["trip_id"], seen, ("mode", "lat", "lon"))
    else:
        placed = dedup_last(placed, ["trip_id"], "mode", ("lat", "lon"))
    placed = placed.select(F.col("trip_id").alias("_trip"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    rest = [c for c in df.columns if c not in ("lat", "lon")]
    ready = df.filter(own)
    lookup = df.filter(~F.coalesce(own, F.lit(False))).select(*rest)
    found = lookup.join(placed, F.col("curr_trip") == F.col("_trip")).select(
        *rest, F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    return ready.select(*rest, "lat", "lon").unionByName(found).filter(
        F.col("lat").isNotNull() & (F.col("lat") != 0))


def anchor_alerts(alerts: DataFrame, vehicles: DataFrame, seen: str | None = None) -> DataFrame:
    """Alerts placed on the map; `lat`/`lon` are optional on the alerts."""
    df = alerts
    for c in ("lat", "lon"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    return _anchored(df, vehicles, seen)


def anchor_forecasts(forecasts: DataFrame, vehicles: DataFrame, seen: str | None = None) -> DataFrame:
    """Forecasts placed on the map at their stop, else at their vehicle."""
    df = forecasts
    if "lat" not in df.columns:
        df = df.withColumnsRenamed({"stop_lat": "lat", "stop_lon": "lon"})
    return _anchored(df, vehicles, seen)


def filter_vehicles(vehicles: DataFrame, modes: tuple[str, ...] = ("subway", "bus"),
                    route: str | None = None) -> DataFrame:
    kept = vehicles.filter(F.col("mode").isin(*modes)) if modes else vehicles.limit(0)
    return kept.filter(F.upper("route_short") == route.upper()) if route else kept


def mappable(vehicles: DataFrame) -> DataFrame:
    """Rows with usable coordinates."""
    return vehicles.filter((F.col("lat") != 0) & (F.col("lon") != 0))
