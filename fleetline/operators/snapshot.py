"""State of the fleet at one moment: latest rows per key, short lists, counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.functions.display import weather_text
from fleetline.functions.ids import arrival_keys, blank_to
from fleetline.functions.times import as_epoch, epoch_seconds, instant
from fleetline.operators.aggregate import fleet_counts, is_live
from fleetline.operators.dedup import dedup_last, top_per_group

# Seconds a row stays valid, and list lengths.
TTL = {"vehicles": 180, "arrivals": 120, "forecasts": 150, "surges": 180, "weather": 1800, "alerts": 3600}
LIMITS = {"vehicles": None, "arrivals": 120, "alerts": 60, "decisions": 60, "forecasts": None}


def fresh(df: DataFrame, ts: str, ttl: int | float, as_of) -> DataFrame:
    """Rows at most `ttl` seconds old and not after `as_of`; the bounds reach the scan."""
    now = as_epoch(as_of)
    return df.filter((F.col(ts) >= instant(df, ts, now - ttl)) & (F.col(ts) <= instant(df, ts, now)))


def latest_state(df: DataFrame, keys: Sequence[str], ts: str, ttl: int | float, as_of,
                 ties: Sequence[str] = ()) -> DataFrame:
    """Newest row per key, if it is still valid. Old rows are dropped before the shuffle."""
    return dedup_last(fresh(df, ts, ttl, as_of), keys, ts, ties)


def unified_vehicles(positions: DataFrame, buses: DataFrame) -> DataFrame:
    """Trains and buses in one schema; `seen` is the event time."""
    none = F.lit(None).cast("double")

    def text(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(""))

    rail = positions.select(
        "trip_id", F.lit("subway").alias("mode"), text("route_id").alias("route_id"),
        text("route_id").alias("route_short"), text("direction").alias("direction"),
        text("stop_id").alias("stop_id"), text("stop_name").alias("stop_name"),
        F.coalesce("stop_lat", F.lit(0.0)).alias("lat"), F.coalesce("stop_lon", F.lit(0.0)).alias("lon"),
        F.coalesce(none, F.lit(-1.0)).alias("bearing"), text("current_status").alias("status"),
        F.col("event_time").alias("seen"))
    road = buses.select(
        "trip_id", F.lit("bus").alias("mode"), text("route_id").alias("route_id"),
        blank_to(F.col("route_short"), text("route_id")).alias("route_short"),
        text("direction").alias("direction"), text("stop_id").alias("stop_id"),
        F.lit("").alias("stop_name"), F.coalesce("vehicle_lat", F.lit(0.0)).alias("lat"),
        F.coalesce("vehicle_lon", F.lit(0.0)).alias("lon"), F.coalesce("bearing", F.lit(-1.0)).alias("bearing"),
        text("current_status").alias("status"), F.col("event_time").alias("seen"))
    return rail.unionByName(road).filter(F.coalesce(F.col("trip_id"), F.lit("")) != "")


def live_vehicles(positions: DataFrame, buses: DataFrame, as_of, ttl: int = TTL["vehicles"]) -> DataFrame:
    """Newest valid row per (mode, trip)."""
    vehicles = unified_vehicles(fresh(positions, "event_time", ttl, as_of), fresh(buses, "event_time", ttl, as_of))
    return dedup_last(vehicles, ["mode", "trip_id"], "seen", ("stop_id", "status"))


def vehicles_snapshot(vehicles: DataFrame, limit: int | None = LIMITS["vehicles"]) -> DataFrame:
    """All vehicles by mode and trip, or the `limit` seen last."""
    if limit is not None:
        return vehicles.orderBy(F.desc("seen"), "mode", "trip_id").limit(limit)
    return vehicles.orderBy("mode", "trip_id")


def eta_at(df: DataFrame, as_of, seen: str = "event_time", high: int = 1800) -> DataFrame:
    """Replaces `eta_seconds` by its value at `as_of`; keeps rows from 0 to `high` seconds."""
    now = int(as_epoch(as_of))
    from_epoch = F.col("arrival_epoch") - F.lit(now)
    counted_down = F.col("eta_seconds") - (F.lit(now) - epoch_seconds(seen))
    eta = F.when(F.coalesce(F.col("arrival_epoch"), F.lit(0)) != 0, from_epoch).otherwise(counted_down)
    return df.withColumn("eta_seconds", eta).filter(F.col("eta_seconds").between(0, high))


ARRIVAL_COLUMNS = ("route_id", "direction", "stop_id", "stop_name", "trip_id", "eta_seconds")
BOARD_ORDER = ("eta_seconds", "route_id", "stop_id", "trip_id")


def soonest_per_route(arrivals: DataFrame, k: int = 6) -> DataFrame:
    """The next `k` arrivals of every route."""
    named = arrivals.withColumn("route_id", F.coalesce(F.col("route_id"), F.lit("")))
    return top_per_group(named, ["route_id"], ["eta_seconds", "stop_id", "trip_id"], k)


def arrivals_snapshot(arrivals: DataFrame, as_of, per_route: int = 6, limit: int = LIMITS["arrivals"],
                      ttl: int | float = TTL["arrivals"]) -> DataFrame:
    """Up to `per_route` next arrivals of every route, soonest first."""
    keyed = arrival_keys(fresh(arrivals, "event_time", ttl, as_of))
    latest = dedup_last(keyed, ["trip_id", "stop_id"], "event_time", ("arrival_epoch",))
    due = eta_at(latest, as_of).select(*ARRIVAL_COLUMNS)
    return soonest_per_route(due, per_route).orderBy(*BOARD_ORDER).limit(limit)


def _newest(df: DataFrame, n: int, ts: str, columns: Sequence[str]) -> DataFrame:
    """The last `n` rows by time, newest first; `ts` in the output is epoch milliseconds."""
    ties = ("route_id", "direction", "stop_id", "curr_trip", "prev_trip")
    order = [F.col(ts).desc(), *[F.col(c) for c in ties if c in df.columns]]
    return df.orderBy(*order).limit(n).select(
        *columns, F.unix_millis(F.col(ts).cast("timestamp")).alias("ts"))


def recent_alerts(alerts: DataFrame, n: int = LIMITS["alerts"], ts: str = "arrival_time") -> DataFrame:
    return _newest(alerts, n, ts, ("route_id", "direction", "stop_id", "stop_name", "alert_type", "severity",
                                   "headway_seconds", "prev_trip", "curr_trip"))


def recent_decisions(decisions: DataFrame, n: int = LIMITS["decisions"], ts: str = "arrival_time") -> DataFrame:
    return _newest(decisions, n, ts, ("route_id", "direction", "stop_id", "stop_name", "alert_type", "action",
                                      "dispatcher_note", "rider_message"))


def order_by_recency(df: DataFrame, ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.coalesce(F.col(ts), F.lit(0)).desc(), *ties)


def latest_forecasts(forecasts: DataFrame, as_of, ttl: int | float = TTL["forecasts"]) -> DataFrame:
    """Newest actionable forecast per (route, direction, stop)."""
    named = (F.col("route_id") != "") & (F.col("stop_id") != "")
    useful = forecasts.filter(named & F.col("forecast_type").isin("PREDICTED_BUNCHING", "PREDICTED_GAP"))
    useful = useful.withColumn("direction", F.coalesce(F.col("direction"), F.lit("")))
    return latest_state(useful, ["route_id", "direction", "stop_id"], "arrival_time", ttl, as_of, ("curr_trip",))


def forecast_snapshot(forecasts: DataFrame, as_of, ttl: int | float = TTL["forecasts"],
                      limit: int | None = LIMITS["forecasts"]) -> DataFrame:
    """All valid forecasts by stop, or the `limit` newest."""
    by_stop, latest = ("route_id", "direction", "stop_id"), latest_forecasts(forecasts, as_of, ttl)
    shown = latest.orderBy(*by_stop) if limit is None else latest.orderBy(F.desc("arrival_time"), *by_stop).limit(limit)
    return shown.select(
        "route_id", "direction", "stop_id", "stop_name", F.col("stop_lat").alias("lat"),
        F.col("stop_lon").alias("lon"), "curr_trip", "forecast_type",
        F.coalesce("headway_seconds", F.lit(0)).alias("headway_seconds"),
        F.coalesce("predicted_headway", F.lit(0)).alias("predicted_headway"))


def normalize_surges(surges: DataFrame) -> DataFrame:
    """Station id from the name when blank, missing counts as 0, level in upper case."""
    station = blank_to(F.col("station_id"), F.nullif(F.col("station_name"), F.lit("")))
    rest = [c for c in surges.columns
            if c not in ("station_id", "station_name", "line", "taps_per_minute", "crowd_level")]
    return surges.select(
        station.alias("station_id"), F.coalesce(F.col("station_name"), station).alias("station_name"),
        F.coalesce("line", F.lit("")).alias("line"),
        F.coalesce("taps_per_minute", F.lit(0)).alias("taps_per_minute"),
        F.upper(blank_to(F.col("crowd_level"), F.lit("NORMAL"))).alias("crowd_level"), *rest,
    ).filter(F.col("station_id").isNotNull())


def surge_snapshot(surges: DataFrame, as_of, ttl: int | float = TTL["surges"]) -> DataFrame:
    """Stations whose newest valid reading is HIGH or SURGE."""
    latest = latest_state(normalize_surges(surges), ["station_id"], "event_time", ttl, as_of,
                          ("taps_per_minute", "line"))
    return latest.filter(F.col("crowd_level").isin("SURGE", "HIGH")).select(
        "station_id", "station_name", "line", "taps_per_minute", "crowd_level")


def _field(df: DataFrame, path: str) -> Column | None:
    fields = df.schema
    for part in path.split("."):
        if part not in fields.names:
            return None
        fields = fields[part].dataType if hasattr(fields[part].dataType, "names") else None
    return F.col(path)


def normalize_weather(weather: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Readable weather values from the nested `current` record, or from flat columns without one."""
    nested = F.col("current").isNotNull() if "current" in weather.columns else F.lit(False)

    def value(name: str, kind: str) -> Column:
        inner, flat = _field(weather, f"current.{name}"), _field(weather, name)
        nothing = F.lit(None).cast(kind)
        return F.when(nested, nothing if inner is None else inner.cast(kind)).otherwise(
            nothing if flat is None else flat.cast(kind))

    def unless_zero(column: Column) -> Column:
        return F.nullif(column, F.lit(0.0))

    temp = F.coalesce(value("temperature_2m", "double"), value("temp", "double"))
    rain = F.coalesce(unless_zero(value("precipitation", "double")), unless_zero(value("rain", "double")), F.lit(0.0))
    wind = F.coalesce(unless_zero(value("wind_speed_10m", "double")), unless_zero(value("wind", "double")), F.lit(0.0))
    code = F.coalesce(value("weather_code", "int"), F.lit(0))
    return weather.select(
        F.bround(temp, 1).alias("temp_c"), F.bround(temp * 9 / 5 + 32, 1).alias("temp_f"),
        weather_text(code).alias("condition"), rain.alias("precip_mm"), F.bround(wind, 1).alias("wind_kph"),
        code.alias("weather_code"), *keep)


def weather_snapshot(weather: DataFrame, as_of, ttl: int | float = TTL["weather"], observed: str = "event_time") -> DataFrame:
    """The newest valid observation, as at most one row."""
    valid = normalize_weather(fresh(weather, observed, ttl, as_of), (observed,))
    ties = [c for c in valid.columns if c != observed]
    return valid.orderBy(F.col(observed).desc(), *ties).limit(1).select(*ties)


def snapshot(tables: Mapping[str, DataFrame], as_of, ttl: Mapping[str, int] | None = None,
             limits: Mapping[str, int] | None = None, live_within: int = 30) -> dict[str, DataFrame]:
    """All parts of the live view at `as_of`, each a lazy table.

    `tables` holds vehicle_positions, bus_positions, arrival_estimates, headway_alerts,
    dispatcher_decisions, headway_forecast, weather_events and passenger_surges.
    """
    age, cap = {**TTL, **(ttl or {})}, {**LIMITS, **(limits or {})}
    vehicles = live_vehicles(tables["vehicle_positions"], tables["bus_positions"], as_of, age["vehicles"])
    alerts = recent_alerts(tables["headway_alerts"], cap["alerts"])
    surges = surge_snapshot(tables["passenger_surges"], as_of, age["surges"])
    time_columns = {
        "vehicle_positions": "event_time", "bus_positions": "event_time", "arrival_estimates": "event_time",
        "headway_alerts": "arrival_time", "dispatcher_decisions": "arrival_time",
        "headway_forecast": "arrival_time", "weather_events": "event_time", "passenger_surges": "event_time",
    }
    return {
        "all_vehicles": vehicles,
        "vehicles": vehicles_snapshot(vehicles, cap["vehicles"]),
        "arrivals": arrivals_snapshot(tables["arrival_estimates"], as_of, limit=cap["arrivals"], ttl=age["arrivals"]),
        "alerts": alerts,
        "decisions": recent_decisions(tables["dispatcher_decisions"], cap["decisions"]),
        "forecasts": forecast_snapshot(tables["headway_forecast"], as_of, age["forecasts"], cap["forecasts"]),
        "weather": weather_snapshot(tables["weather_events"], as_of, age["weather"]),
        "surges": surges,
        "counts": fleet_counts(vehicles, fresh(tables["headway_alerts"], "arrival_time", age["alerts"], as_of), surges),
        "live": is_live({k: (tables[k], ts) for k, ts in time_columns.items()}, as_of, live_within),
    }
