"""The derived tables, each a function from tables to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.functions import rules
from fleetline.functions.times import as_epoch
from fleetline.operators.aggregate import corridor_congestion
from fleetline.operators.agent import dispatcher_decisions
from fleetline.operators.dedup import dedup_first, dedup_last
from fleetline.operators.enrich import station_bottlenecks, weather_impact
from fleetline.operators.sequence import headway, headway_forecast
from fleetline.session import staged

STOP_COLUMNS = ("trip_id", "route_id", "direction", "stop_id", "stop_name", "stop_lat", "stop_lon")


def latest_predictions(trip_updates: DataFrame) -> DataFrame:
    """Newest usable prediction per (trip, stop); rows without an arrival never replace one that has it."""
    usable = trip_updates.filter(F.col("arrival_epoch") > 0)
    latest = dedup_last(usable.select(*STOP_COLUMNS, "arrival_epoch", "event_time"),
                        ["trip_id", "stop_id"], "event_time", ("arrival_epoch",))
    return latest


def within_eta(predictions: DataFrame, as_of, low: int = -30, high: int = 1800) -> DataFrame:
    """Seconds to arrival at `as_of`, for predictions inside the board's range."""
    eta = F.col("arrival_epoch") - F.lit(int(as_epoch(as_of)))
    return predictions.withColumn("eta_seconds", eta).filter(F.col("eta_seconds").between(low, high))


def arrival_estimates(trip_updates: DataFrame, as_of, low: int = -30, high: int = 1800) -> DataFrame:
    return within_eta(latest_predictions(trip_updates), as_of, low, high).select(
        "trip_id", "stop_id", "route_id", "direction", "stop_name", "stop_lat", "stop_lon",
        "arrival_epoch", "eta_seconds", "event_time")


def first_arrivals(positions: DataFrame, service_date: bool = False) -> DataFrame:
    """One arrival per (trip, stop): the first frame in which the vehicle is stopped there.

    `service_date` adds the calendar day to the key, for trip ids that repeat every day.
    """
    stopped = positions.filter(F.col("current_status") == "STOPPED_AT").select(*STOP_COLUMNS, "event_time")
    ties = ("route_id", "direction", "stop_name")
    if not service_date:
        return dedup_first(stopped, ["trip_id", "stop_id"], "event_time", ties)
    dated = stopped.withColumn("_day", F.to_date("event_time"))
    return dedup_first(dated, ["trip_id", "stop_id", "_day"], "event_time", ties).drop("_day")


def headway_alerts(headways: DataFrame, bunch: int = rules.BUNCH_BELOW, gap: int = rules.GAP_ABOVE,
                   high_bunch: int = rules.HIGH_BELOW, high_gap: int = rules.HIGH_ABOVE) -> DataFrame:
    seconds = F.col("headway_seconds")
    return headways.filter(rules.outside(seconds, bunch, gap)).select(
        "route_id", "direction", "stop_id", "stop_name", "stop_lat", "stop_lon", "prev_trip", "curr_trip",
        "headway_seconds", rules.alert_type(seconds, bunch, gap).alias("alert_type"),
        rules.alert_severity(seconds, bunch, gap, high_bunch, high_gap).alias("severity"), "arrival_time")


def run(tables: dict[str, DataFrame], as_of, window: str = "1 minute", width: str = "1 hour",
        stage: bool = False) -> dict[str, DataFrame]:
    """All derived tables from the feeds present in `tables`.

    Nothing is computed until one is used. With `stage` the arrivals and the alerts, which several tables
    share, are written to the shared folder first, so that each is computed once.
    """
    keep = staged if stage else (lambda df, label: df)
    out: dict[str, DataFrame] = {}
    if "trip_updates" in tables:
        out["arrival_estimates"] = arrival_estimates(tables["trip_updates"], as_of)
    if "vehicle_positions" in tables:
        arrivals = keep(first_arrivals(tables["vehicle_positions"]), "arrivals")
        out["headway"] = headway(arrivals, width=width)
        out["headway_forecast"] = headway_forecast(arrivals, width=width)
        out["headway_alerts"] = keep(headway_alerts(out["headway"]), "alerts")
        out["dispatcher_decisions"] = dispatcher_decisions(out["headway_alerts"])
        if "weather_events" in tables:
            out["weather_impact_alerts"] = weather_impact(out["headway_alerts"], tables["weather_events"])
        if "passenger_surges" in tables:
            out["station_bottlenecks"] = station_bottlenecks(out["headway_alerts"], tables["passenger_surges"])
    if "bus_positions" in tables:
        out["bus_corridor_speed"] = corridor_congestion(tables["bus_positions"], window)
    return out


def register_views(tables: dict[str, DataFrame]) -> None:
    """Makes tables available to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
