import random

import pytest
from pyspark.sql import functions as F

from fleetline.operators import context, snapshot
from fleetline.operators.aggregate import feed_stats, is_live, top_routes
from fleetline.operators.board import ARRIVING, BRACKET_ENDS, diverse_board
from fleetline.schemas import FEED
from helpers import ALERTS, alert, at, rows

NOW = at(1000)
EPOCH = 1704067200 + 1000
ARR = ("trip_id string, stop_id string, route_id string, direction string, stop_name string, "
       "arrival_epoch long, eta_seconds long, event_time timestamp_ntz")


def arrivals(spark, data):
    """(trip, route, eta, age)"""
    return spark.createDataFrame(
        [(t, f"s{t}", r, "N", "Stop", EPOCH + eta, None, at(1000 - age)) for t, r, eta, age in data], ARR)


def test_arrivals_snapshot(spark):
    data = [(f"t{i}", "1", 60 * (15 - i), 0) for i in range(15)] + [("a", "A", 45, 120), ("b", "7", 10, 121), ("c", "7", -1, 0), ("d", "7", 1801, 0)]
    got = snapshot.arrivals_snapshot(arrivals(spark, data), NOW).collect()
    assert [r.eta_seconds for r in got] == [45, 60, 120, 180, 240, 300, 360]
    again = snapshot.arrivals_snapshot(arrivals(spark, data), NOW, limit=2).collect()
    assert [r.route_id for r in again] == ["A", "1"]


def test_newest_prediction_wins(spark):
    df = arrivals(spark, [("t", "1", 500, 50)]).union(arrivals(spark, [("t", "1", 300, 10)]))
    assert rows(snapshot.arrivals_snapshot(df, NOW), "eta_seconds") == [(300,)]


FORECAST = ("route_id string, direction string, stop_id string, stop_name string, stop_lat double, stop_lon double, "
            "curr_trip string, headway_seconds long, predicted_headway long, forecast_type string, arrival_time timestamp_ntz")


def forecast(predicted, age, kind="PREDICTED_BUNCHING", route="1", stop="s"):
    return (route, "N", stop, "Stop", 1.0, 2.0, "c", 200, predicted, kind, at(1000 - age))


def test_forecast_snapshot(spark):
    df = spark.createDataFrame(
        [forecast(80, 100), forecast(55, 20), forecast(10, 1, "STABLE"), forecast(10, 1, route=""),
         forecast(10, 1, stop=""), forecast(99, 150, "PREDICTED_GAP", stop="x"), forecast(99, 151, stop="y")], FORECAST)
    assert rows(snapshot.forecast_snapshot(df, NOW), "stop_id", "predicted_headway") == [("s", 55), ("x", 99)]


def test_surge_snapshot_takes_latest_before_filtering(spark):
    now_ms = EPOCH * 1000
    df = spark.createDataFrame(
        [("a", "A", "L1", 5, "SURGE", now_ms - 5000), ("b", "B", "L1", 5, "SURGE", now_ms - 5000),
         ("b", "B", "L1", 5, "NORMAL", now_ms - 1000), ("c", "C", "L1", 5, "HIGH", now_ms - 180_000),
         ("d", "D", "L1", 5, "HIGH", now_ms - 180_001)],
        "station_id string, station_name string, line string, taps_per_minute int, crowd_level string, event_time long")
    assert rows(snapshot.surge_snapshot(df, NOW), "station_id") == [("a",), ("c",)]


@pytest.mark.parametrize("age, kept", [(200, 1), (1800, 1), (1900, 0)])
def test_weather_expires(spark, age, kept):
    df = spark.createDataFrame([((18.5, 0.2, 61, 14.0), at(1000 - age))],
                               "current struct<temperature_2m: double, precipitation: double, weather_code: int, "
                               "wind_speed_10m: double>, event_time timestamp_ntz")
    assert snapshot.weather_snapshot(df, NOW).count() == kept


def test_recent_lists(spark):
    df = spark.createDataFrame([alert(i, curr=f"c{i}") for i in range(70)], ALERTS)
    got = snapshot.recent_alerts(df).collect()
    assert len(got) == 60 and got[0].curr_trip == "c69" and got[0].ts == 1704067200000 + 69000
    assert [r.ts for r in snapshot.order_by_recency(spark.createDataFrame([(1,), (None,), (3,)], "ts long")).collect()] == [3, 1, None]


def test_liveness_is_strict(spark):
    def live(age):
        df = spark.createDataFrame([(at(1000 - age),)], "ts timestamp_ntz")
        return is_live({"x": (df, "ts"), "y": (df.limit(0), "ts")}, NOW).first().live
    assert live(29.9) and not live(30)


def vehicle_tables(spark):
    rail = spark.createDataFrame(
        [("t1", "1", "N", "s", "Stop", 1.0, 2.0, "STOPPED_AT", at(900)), ("t1", "1", "N", "s2", "Stop", 1.5, 2.0, "STOPPED_AT", at(950)),
         ("t2", "1", "N", "s", None, None, None, None, at(1000 - 181)), ("", "1", "N", "s", "x", 1.0, 1.0, "", at(999))],
        "trip_id string, route_id string, direction string, stop_id string, stop_name string, stop_lat double, "
        "stop_lon double, current_status string, event_time timestamp_ntz")
    road = spark.createDataFrame(
        [("t1", "CITY_M1", "M1", "0", "", 3.0, 4.0, None, "STOPPED_AT", at(990)), ("b", "M2", "", "1", "", 3.0, 4.0, 90.0, "x", at(990))],
        "trip_id string, route_id string, route_short string, direction string, stop_id string, vehicle_lat double, "
        "vehicle_lon double, bearing double, current_status string, event_time timestamp_ntz")
    return rail, road


def test_live_vehicles(spark):
    got = rows(snapshot.live_vehicles(*vehicle_tables(spark), NOW), "mode", "trip_id", "route_short", "stop_id", "bearing")
    assert got == [("bus", "b", "M2", "", 90.0), ("bus", "t1", "M1", "", -1.0), ("subway", "t1", "1", "s2", -1.0)]


def test_snapshot_and_context(spark):
    rail, road = vehicle_tables(spark)
    decisions = spark.createDataFrame([alert(999) + ("MONITOR", "watch", "wait")],
                                      ALERTS + ", action string, dispatcher_note string, rider_message string")
    surges = spark.createDataFrame([("a", "Hall", "L1", 900, "SURGE", (EPOCH - 1) * 1000)],
                                   "station_id string, station_name string, line string, taps_per_minute int, crowd_level string, event_time long")
    sky = spark.createDataFrame([((18.5, 0.2, 61, 14.0), at(990))],
                                "current struct<temperature_2m: double, precipitation: double, weather_code: int, wind_speed_10m: double>, event_time timestamp_ntz")
    tables = {
        "vehicle_positions": rail, "bus_positions": road, "arrival_estimates": arrivals(spark, [("t", "1", 60, 5)]),
        "headway_alerts": spark.createDataFrame([alert(999, name="")], ALERTS), "dispatcher_decisions": decisions,
        "headway_forecast": spark.createDataFrame([forecast(55, 20)], FORECAST), "weather_events": sky, "passenger_surges": surges}
    snap = snapshot.snapshot(tables, NOW)
    assert tuple(snap["counts"].first()) == (1, 2, 3, 1, 1)
    text = context.context_text(context.context_rows(snap)).first().text.split("\n")
    assert text == [
        "LIVE FLEET: 1 subway trains, 2 buses, 3 active routes, 1 headway alerts. data_live=True",
        "SUBWAY LINES RUNNING: 1(1)", "BUS ROUTES RUNNING: M1(1), M2(1)", context.HEADINGS[4],
        "  - 1 GAP [MEDIUM] @ 101N (1000s)", context.HEADINGS[5], "  - 1: MONITOR — watch", context.HEADINGS[6],
        "  - 1 @ Stop in 60s", "WEATHER: Light Rain, 65.3°F (18.5°C), rain: 0.2mm, wind: 14.0 km/h",
        "STATION PASSENGER SURGES: Hall [L1] (SURGE, 900 taps/min)"]


def test_empty_context_has_one_line(spark):
    rail, road = vehicle_tables(spark)
    empty = {"vehicle_positions": rail, "bus_positions": road, "arrival_estimates": arrivals(spark, [("t", "1", 60, 5)]).limit(0),
             "headway_alerts": spark.createDataFrame([], ALERTS),
             "dispatcher_decisions": spark.createDataFrame([], ALERTS + ", action string, dispatcher_note string, rider_message string"),
             "headway_forecast": spark.createDataFrame([], FORECAST),
             "weather_events": spark.createDataFrame([], "current struct<weather_code: int>, event_time timestamp_ntz"),
             "passenger_surges": spark.createDataFrame([], "station_id string, station_name string, line string, taps_per_minute int, crowd_level string, event_time long")}
    lines = context.context_lines(context.context_rows(snapshot.snapshot(empty, at(90000)))).collect()
    assert [r.line for r in lines] == ["LIVE FLEET: 0 subway trains, 0 buses, 0 active routes, 0 headway alerts. data_live=False"]


def test_top_routes(spark):
    cars = spark.createDataFrame([("bus", f"M{i % 25}") for i in range(60)] + [("subway", "A")] * 3 + [("subway", "")],
                                 "mode string, route_short string")
    got = top_routes(cars).orderBy("mode", "position").collect()
    assert len(got) == 21 and got[0].route_short == "M0" and got[0].vehicles == 3 and got[-1].route_short == "A"


def test_feed_stats(spark):
    trip = ("t", "r", 0)
    car = (trip, "v", "s", 1, 1, 5, None)
    feed = spark.createDataFrame([("x", 1, car, None), ("x", 1, None, (trip, [])), ("y", 1, car, None)], FEED)
    assert sorted(map(tuple, feed_stats(feed).collect()), key=str) == [("x", 2, 1, 1), ("y", 1, 1, 0), (None, 3, 2, 1)]


def plain_board(items, key_of, n):
    """The three passes over a whole list, written as plainly as possible."""
    items = sorted(items, key=lambda a: (a[2], a[1], a[3], a[0]))
    picked, seen = [], set()
    low = 0
    for high in BRACKET_ENDS:
        for a in items:
            if len(picked) < n and low <= a[2] < high and key_of(a) and key_of(a) not in seen:
                picked.append(a)
                seen.add(key_of(a))
                break
        low = high
    for a in items:
        if len(picked) < n and a[2] >= ARRIVING and a not in picked and key_of(a) not in seen:
            picked.append(a)
            if key_of(a):
                seen.add(key_of(a))
    for a in items:
        if len(picked) < n and a not in picked:
            picked.append(a)
    return sorted(picked, key=lambda a: (a[2], a[1], a[3], a[0]))


@pytest.mark.parametrize("seed, routes, n", [(1, 30, 8), (2, 3, 8), (3, 12, 5), (4, 1, 8), (5, 200, 8)])
def test_board_matches_full_search(spark, seed, routes, n):
    rnd = random.Random(seed)
    items = []
    for board in range(25):
        for i in range(rnd.choice([1, 5, 40, 150])):
            route = rnd.choice(["", *[f"r{j}" for j in range(routes)]])
            eta = rnd.choice([rnd.randrange(30), rnd.randrange(300), rnd.randrange(2000)])
            items.append((f"t{i}", route, eta, f"s{rnd.randrange(6)}", board))
    df = spark.createDataFrame(items, "trip_id string, route_id string, eta_seconds long, stop_id string, board int")
    df = df.withColumn("stop_name", F.lit(""))
    got = {}
    for r in diverse_board(df, ("board",), n).orderBy("board", "position").collect():
        got.setdefault(r.board, []).append((r.trip_id, r.route_id, r.eta_seconds, r.stop_id, r.board))
    for board in range(25):
        mine = [a for a in items if a[4] == board]
        assert got[board] == plain_board(mine, lambda a: a[1].upper(), n)
    everything = [(r.trip_id, r.route_id, r.eta_seconds, r.stop_id, r.board)
                  for r in diverse_board(df.drop("board").withColumn("board", F.lit(0)), (), n).orderBy("position").collect()]
    assert everything == plain_board([(*a[:4], 0) for a in dict.fromkeys((*a[:4], 0) for a in items)], lambda a: a[1].upper(), n) or len(
        {a[:4] for a in items}) < len(items)
    one = [(r.trip_id, r.eta_seconds) for r in diverse_board(df, ("board",), n, route="R0").filter("board = 0").orderBy("position").collect()]
    assert one == [(a[0], a[2]) for a in plain_board([a for a in items if a[4] == 0 and a[1] == "r0"], lambda a: a[3], n)]


def test_board_example(spark):
    items = [("a", "1", 5), ("b", "2", 12), ("c", "3", 20), ("d", "A", 100), ("e", "C", 200), ("f", "E", 400), ("g", "7", 600), ("h", "L", 900), ("i", "G", 1200)]
    df = spark.createDataFrame([(t, r, eta, "s", "Stop") for t, r, eta in items],
                               "trip_id string, route_id string, eta_seconds long, stop_id string, stop_name string")
    got = diverse_board(df).collect()
    assert len(got) == 8 and len({r.route_id for r in got}) == 8 and sum(r.eta_seconds < 30 for r in got) <= 2
