import pytest
from pyspark.sql import functions as F

from fleetline.functions import display, ids, rules
from fleetline.functions.jsons import json_object
from fleetline.functions.times import as_epoch, duration_seconds, seconds_between, time_slice
from fleetline.operators.snapshot import eta_at, normalize_surges, normalize_weather
from fleetline.schemas import struct
from helpers import at, value


def column(spark, fn, values, kind="long"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_alert_bounds(spark):
    edges = [74, 75, 149, 150, 900, 901, 1500, 1501]
    assert column(spark, rules.alert_type, edges) == ["BUNCHING"] * 3 + ["NORMAL"] * 2 + ["GAP"] * 3
    assert column(spark, rules.alert_severity, edges) == [
        "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH"]


@pytest.mark.parametrize("kind, headway, expected", [
    ("BUNCHING", 60, "HOLD TRAIN"), ("BUNCHING", 89, "HOLD TRAIN"), ("BUNCHING", 90, "MONITOR"),
    ("BUNCHING", 149, "MONITOR"), ("GAP", 1201, "GAP FILL"), ("GAP", 1200, "MONITOR"),
    ("GAP", 950, "MONITOR"), ("", 500, "MONITOR"), (" bunching ", 60, "HOLD TRAIN"), (None, 10, "MONITOR")])
def test_expected_action(spark, kind, headway, expected):
    assert value(spark, rules.expected_action(F.lit(kind).cast("string"), F.lit(headway))) == expected


@pytest.mark.parametrize("predicted, current, expected", [
    (149, 150, "PREDICTED_BUNCHING"), (149, 149, "STABLE"), (150, 150, "STABLE"),
    (901, 900, "PREDICTED_GAP"), (901, 901, "STABLE"), (900, 900, "STABLE")])
def test_forecast_type(spark, predicted, current, expected):
    assert value(spark, rules.forecast_type(F.lit(predicted), F.lit(current))) == expected


@pytest.mark.parametrize("trips, stopped, expected", [
    (10, 4, "MODERATE"), (10, 5, "HEAVY"), (9, 9, "MODERATE"), (5, 2, "MODERATE"), (4, 4, "LIGHT"),
    (8, 2, "LIGHT"), (0, 3, "LIGHT")])
def test_congestion_level(spark, trips, stopped, expected):
    assert value(spark, rules.congestion_level(F.lit(trips), F.lit(stopped))) == expected


def test_weather_rules(spark):
    codes = [None, 0, 1, 50, 51, 79, 80]
    assert column(spark, rules.weather_condition, codes, "int") == [
        "CLEAR", "CLEAR", "OVERCAST", "OVERCAST", "DRIZZLE", "DRIZZLE", "RAIN_SHOWERS"]
    high, some, none = "HIGH_WEATHER_DISRUPTION", "MODERATE_WEATHER_RISK", "NORMAL_TRACK_CONDITIONS"
    cases = [(0.0, 15.0, none), (0.0, 15.1, some), (0.1, 0.0, some), (1.0, 30.0, some), (1.1, 0.0, high),
             (0.0, 30.1, high), (None, None, none)]
    for rain, wind, expected in cases:
        got = rules.weather_risk(F.lit(rain).cast("double"), F.lit(wind).cast("double"))
        assert value(spark, got) == expected


@pytest.mark.parametrize("crowd, kind, severity, level, advice", [
    ("SURGE", "GAP", "MEDIUM", "CRITICAL", "DEPLOY GAP FILL & PLATFORM CROWD CONTROL"),
    ("SURGE", "BUNCHING", "MEDIUM", "ELEVATED", "HOLD LEADING TRAIN TO ABSORB PASSENGERS"),
    ("HIGH", "GAP", "MEDIUM", "ELEVATED", "MONITOR PASSENGER SURGE CONGESTION"),
    ("NORMAL", "GAP", "HIGH", "ELEVATED", "MONITOR PASSENGER SURGE CONGESTION"),
    ("NORMAL", "GAP", "LOW", "WATCH", "MONITOR PASSENGER SURGE CONGESTION")])
def test_bottleneck_rules(spark, crowd, kind, severity, level, advice):
    assert value(spark, rules.bottleneck_severity(F.lit(crowd), F.lit(kind), F.lit(severity))) == level
    assert value(spark, rules.bottleneck_recommendation(F.lit(crowd), F.lit(kind))) == advice


def test_status_names(spark):
    assert column(spark, rules.status_name, [0, 1, 2, 3, None], "int") == [
        "INCOMING_AT", "STOPPED_AT", "IN_TRANSIT_TO", "IN_TRANSIT_TO", "IN_TRANSIT_TO"]


def test_eta_text(spark):
    assert column(spark, display.eta_text, [0, 15, 29, 30, 59, 65, 120, 255]) == [
        "arriving", "arriving", "arriving", "30s", "59s", "1m 05s", "2m 00s", "4m 15s"]


def test_labels(spark):
    assert column(spark, display.direction_label, ["N", "S", "0", "1", "E", "", None], "string") == [
        "Uptown", "Downtown", "→", "←", "E", "--", "--"]
    assert column(spark, display.weather_text, [0, 3, 61, 95, 62, None], "int") == [
        "Clear Sky", "Overcast", "Light Rain", "Thunderstorm", "Partly Cloudy", "Partly Cloudy"]


def test_identifiers(spark):
    assert column(spark, ids.base_id, ["221N", "221S", "221", "", None], "string") == ["221", "221", "221", "", None]
    assert column(spark, ids.route_short, ["ACME NY_M15", "AB_ Q39 ", "M15", "a_b_c", "", None], "string") == [
        "M15", "Q39", "M15", "b_c", "", ""]
    assert column(spark, ids.agency_of, ["ACME NY_9", "9", "", None], "string") == ["ACME NY", "", "", ""]
    assert column(spark, lambda c: ids.agency_selected(c, "acme ny, x"), ["ACME NY_9", "Y_9"], "string") == [True, False]
    assert column(spark, lambda c: ids.agency_selected(c, "All"), ["Y_9", None], "string") == [True, True]
    cases = [("101N", "t", "N"), ("101", "tripS", "S"), ("101", "trip", "U"), ("", "", "U"), (None, None, "U")]
    for stop, trip, expected in cases:
        got = ids.direction(F.lit(stop).cast("string"), F.lit(trip).cast("string"))
        assert value(spark, got) == expected


def test_arrival_keys(spark):
    df = spark.createDataFrame(
        [("t", "c", "1", "N", "s", "n"), ("", "c", "1", "N", "", "n"), (None, "", "1", None, None, "n"),
         ("t", "c", "1", "N", "", "")],
        "trip_id string, curr_trip string, route_id string, direction string, stop_id string, stop_name string")
    got = [(r.trip_id, r.stop_id) for r in ids.arrival_keys(df).collect()]
    assert got == [("t", "s"), ("c", "n"), ("1-None-n", "n")]


def test_times(spark):
    assert duration_seconds("5 minutes") == 300 and duration_seconds("1 hour") == 3600 and duration_seconds(7) == 7
    assert as_epoch("1970-01-01 00:01:00") == 60 and as_epoch(at(0)) == 1704067200
    df = spark.createDataFrame([(at(0.9), at(1.8)), (at(1.8), at(0.9)), (at(0), at(3599.999))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(seconds_between(F.col("a"), F.col("b"))).collect()] == [0, 0, 3599]
    assert [r[0] for r in df.select(time_slice("b", "1 hour") - time_slice("a", 3600)).collect()] == [0, 0, 0]


def test_json_object_is_strict(spark):
    texts = ['{"a": 1}', ' {"a": 2} ', '{"a": 3} x', '{"a": 4}, {"a": 5}', "5", "", "{", '{"a": "x"}']
    got = column(spark, lambda c: json_object(c, struct(a="int"))["a"], texts, "string")
    assert got == [1, 2] + [None] * 6


def test_eta_at(spark):
    df = spark.createDataFrame(
        [(1100, None, at(0)), (0, 300, at(-100)), (0, None, at(0)), (0, 99, at(-100)), (1704067200 + 1801, 0, at(0)),
         (1704067200 + 1800, 0, at(0))],
        "arrival_epoch long, eta_seconds long, event_time timestamp_ntz")
    assert [r.eta_seconds for r in eta_at(df, at(0)).collect()] == [200, 1800]


def test_weather_values(spark):
    nested = struct(current=struct(temperature_2m="double", precipitation="double", rain="double",
                                   weather_code="int", wind_speed_10m="double"))
    df = spark.createDataFrame([((18.5, 0.2, 0.0, 61, 14.0),), ((None, 0.0, 0.7, None, None),)], nested)
    first, second = normalize_weather(df).collect()
    assert tuple(first) == (18.5, 65.3, "Light Rain", 0.2, 14.0, 61)
    assert tuple(second) == (None, None, "Clear Sky", 0.7, 0.0, 0)
    flat = spark.createDataFrame([(21.25, 0.4, 3, 5.0)], "temp double, rain double, weather_code int, wind double")
    assert tuple(normalize_weather(flat).first()) == (21.2, 70.2, "Overcast", 0.4, 5.0, 3)


def test_surge_values(spark):
    df = spark.createDataFrame(
        [("", "Hall", "L1", None, "surge", 1), ("A", None, None, 5, None, 2), (None, "", "L1", 1, "HIGH", 3)],
        "station_id string, station_name string, line string, taps_per_minute int, crowd_level string, event_time long")
    got = [tuple(r) for r in normalize_surges(df).collect()]
    assert got == [("Hall", "Hall", "L1", 0, "SURGE", 1), ("A", "A", "", 5, "NORMAL", 2)]
