"""Small tables for tests."""

from datetime import datetime, timedelta

START = datetime(2024, 1, 1)

ARRIVALS = ("trip_id string, route_id string, direction string, stop_id string, stop_name string, "
            "stop_lat double, stop_lon double, event_time timestamp_ntz")
ALERTS = ("route_id string, direction string, stop_id string, stop_name string, stop_lat double, stop_lon double, "
          "prev_trip string, curr_trip string, headway_seconds bigint, alert_type string, severity string, "
          "arrival_time timestamp_ntz")


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def arrival(trip, seconds, route="1", direction="N", stop="101N"):
    return (trip, route, direction, stop, f"Stop {stop}", 40.7, -73.9, at(seconds))


def alert(seconds, kind="GAP", headway=1000, route="1", direction="N", stop="101N", name="Main St",
          prev="p", curr="c", severity="MEDIUM"):
    return (route, direction, stop, name, 40.7, -73.9, prev, curr, headway, kind, severity, at(seconds))


def rows(df, *columns):
    """Sorted tuples of the given columns."""
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]
