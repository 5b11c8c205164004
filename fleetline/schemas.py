"""Schemas of the feeds and static tables."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
    "time": T.TimestampNTZType(), "zoned": T.TimestampType(),
}


def struct(required: bool = False, **fields: str | T.DataType) -> T.StructType:
    """A struct type from `name="kind"` pairs; a kind may also be a full type."""
    return T.StructType([T.StructField(n, _KINDS[k] if isinstance(k, str) else k, not required)
                         for n, k in fields.items()])


def array(kind: str | T.DataType) -> T.ArrayType:
    return T.ArrayType(_KINDS[kind] if isinstance(kind, str) else kind)


VEHICLE_POSITIONS = struct(
    trip_id="string", route_id="string", direction="string", stop_id="string", stop_base="string",
    stop_name="string", stop_lat="double", stop_lon="double", current_status="string",
    stop_sequence="int", event_time="time")
TRIP_UPDATES = struct(
    trip_id="string", route_id="string", direction="string", stop_id="string", stop_base="string",
    stop_name="string", stop_lat="double", stop_lon="double", arrival_epoch="long",
    departure_epoch="long", event_time="time")
BUS_POSITIONS = struct(
    trip_id="string", route_id="string", route_short="string", direction="string", stop_id="string",
    vehicle_lat="double", vehicle_lon="double", bearing="double", current_status="string", event_time="time")
SERVICE_ALERTS = struct(
    alert_id="string", event_id="string", update_number="string", agency="string", affected="string",
    status_label="string", header="string", description="string", date="long")
_CURRENT = {"time": "string", "interval": "int", "temperature_2m": "double", "relative_humidity_2m": "int",
            "precipitation": "double", "rain": "double", "weather_code": "int", "wind_speed_10m": "double"}
WEATHER_EVENTS = struct(
    latitude="double", longitude="double", generationtime_ms="double", elevation="double",
    utc_offset_seconds="int", timezone="string", timezone_abbreviation="string",
    current=struct(**_CURRENT), current_units=struct(**dict.fromkeys(_CURRENT, "string")))
PASSENGER_SURGES = struct(
    required=True, station_id="string", station_name="string", line="string", taps_per_minute="int",
    crowd_level="string", event_time="long")
HEADWAY = struct(
    route_id="string", direction="string", stop_id="string", stop_name="string", stop_lat="double",
    stop_lon="double", prev_trip="string", curr_trip="string", headway_seconds="long", arrival_time="time")
DECISIONS_JSONL = struct(
    route_id="string", direction="string", stop_id="string", stop_name="string", alert_type="string",
    severity="string", headway_seconds="long", action="string", llm_action="string", dispatcher_note="string")

_TRIP = struct(trip_id="string", route_id="string", direction_id="int")
FEED = struct(
    feed="string", feed_ts="long",
    vehicle=struct(trip=_TRIP, vehicle_id="string", stop_id="string", current_status="int",
                   current_stop_sequence="int", timestamp="long",
                   position=struct(latitude="double", longitude="double", bearing="double")),
    trip_update=struct(trip=_TRIP, stop_time_update=array(struct(stop_id="string", arrival="long", departure="long"))))
SHAPE_FILE = struct(
    type="string",
    features=array(struct(
        type="string",
        properties=struct(route_id="string", route_short="string", mode="string", color="string", part="long"),
        geometry=struct(type="string", coordinates=array(array("double"))))))
STOPS = struct(stop_id="string", stop_name="string", stop_lat="double", stop_lon="double")
