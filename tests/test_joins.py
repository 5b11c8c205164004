import random

from fleetline.operators import aggregate, enrich
from fleetline.operators.asof import asof_join
from helpers import ALERTS, alert, at, rows


def plain_asof(left, right, tolerance, entity):
    out = []
    for key, t, name in left:
        for e in ({r[3] for r in right} if entity else {None}):
            fit = [r for r in right if r[0] == key and r[1] <= t and (not entity or r[3] == e)]
            if fit:
                best = max(fit, key=lambda r: (r[1], r[2]))
                if t - best[1] <= tolerance:
                    out.append((name, best[2]) + ((e,) if entity else ()))
    return sorted(out)


def test_asof_join_matches_search(spark):
    rnd = random.Random(5)
    left = [(rnd.choice("aaab"), rnd.randrange(40000), i) for i in range(250)]
    right = [(rnd.choice("aaab"), rnd.randrange(40000), i, rnd.choice("xyz")) for i in range(200)]
    ldf = spark.createDataFrame([(k, at(t), n) for k, t, n in left], "k string, ts timestamp_ntz, name int").repartition(4)
    rdf = spark.createDataFrame([(k, at(t), n, e) for k, t, n, e in right],
                                "k string, seen timestamp_ntz, v int, e string").repartition(4)
    for tolerance, width in ((600, None), (3000, 700), (100, 5000)):
        got = asof_join(ldf, rdf, "ts", "seen", tolerance, keys=("k",), ties=("v",), width=width)
        assert rows(got, "name", "v") == plain_asof(left, right, tolerance, False)
        got = asof_join(ldf, rdf, "ts", "seen", tolerance, keys=("k",), entity=("e",), ties=("v",), width=width)
        assert rows(got, "name", "v", "e") == plain_asof(left, right, tolerance, True)


def test_asof_join_ignores_missing_keys(spark):
    left = spark.createDataFrame([(None, at(10), 1)], "k string, ts timestamp_ntz, name int")
    right = spark.createDataFrame([(None, at(5), 1), ("a", None, 2)], "k string, seen timestamp_ntz, v int")
    assert asof_join(left, right, "ts", "seen", 60, keys=("k",)).count() == 0


def weather(spark, data):
    return spark.createDataFrame(
        [((temp, rain, wind, code), at(s)) for s, temp, rain, wind, code in data],
        "current struct<temperature_2m: double, precipitation: double, wind_speed_10m: double, weather_code: int>, "
        "event_time timestamp_ntz")


def test_weather_impact(spark):
    alerts = spark.createDataFrame([alert(1800), alert(1801, curr="d"), alert(3000, curr="e")], ALERTS)
    sky = weather(spark, [(0, 1.0, 0.0, 16.0, 61), (2000, None, None, None, None)])
    got = rows(enrich.weather_impact(alerts, sky), "arrival_time", "temperature_c", "precipitation_mm",
               "wind_speed_kmh", "weather_condition", "weather_risk_level")
    assert got == [(at(1800), 1.0, 0.0, 16.0, "DRIZZLE", "MODERATE_WEATHER_RISK"),
                   (at(3000), 18.0, 0.0, 5.0, "CLEAR", "NORMAL_TRACK_CONDITIONS")]


def surges(spark, data):
    return spark.createDataFrame(
        [(station, f"Hall {station}", line, taps, level, 1704067200000 + s * 1000)
         for station, line, taps, level, s in data],
        "station_id string, station_name string, line string, taps_per_minute int, crowd_level string, event_time long")


def test_station_bottlenecks_use_each_stations_current_reading(spark):
    alerts = spark.createDataFrame([alert(1000), alert(1000, kind="BUNCHING", route="2", curr="d")], ALERTS)
    readings = surges(spark, [
        ("A", "L1", 900, "SURGE", 900), ("B", "L1", 800, "SURGE", 850), ("B", "L1", 300, "NORMAL", 950),
        ("C", "L1", 700, "HIGH", 819), ("D", "L1", 600, "HIGH", 1001), ("E", "L2", 500, "SURGE", 1000)])
    got = rows(enrich.station_bottlenecks(alerts, readings), "station_name", "subway_line", "bottleneck_severity")
    assert got == [("Hall A", "1", "CRITICAL"), ("Hall E", "2", "ELEVATED")]


def test_stop_lookup(spark):
    stops = spark.createDataFrame([("101", "Base", 1.0, 2.0), ("102N", "Exact", 3.0, 4.0), ("102", "Plain", 5.0, 6.0)],
                                  "stop_id string, stop_name string, stop_lat double, stop_lon double")
    df = spark.createDataFrame([("101N",), ("102N",), ("102S",), ("999",), (None,)], "stop_id string")
    got = [tuple(r)[1:] for r in enrich.with_stop_info(df, stops).collect()]
    assert sorted(got) == sorted([("Base", 1.0, 2.0), ("Exact", 3.0, 4.0), ("Plain", 5.0, 6.0), ("", 0.0, 0.0), ("", 0.0, 0.0)])


def test_anchors(spark):
    cars = spark.createDataFrame(
        [("bus", "c", 1.0, 2.0, at(1)), ("subway", "c", 3.0, 4.0, at(2)), ("bus", "z", 0.0, 5.0, at(1))],
        "mode string, trip_id string, lat double, lon double, seen timestamp_ntz")
    own = spark.createDataFrame(
        [("own", "c", 9.0, 8.0), ("half", "c", 9.0, None), ("zero", "c", 0.0, 8.0), ("lost", "q", None, None),
         ("origin", "z", None, None), ("none", None, None, None)],
        "name string, curr_trip string, lat double, lon double")
    got = rows(enrich.anchor_alerts(own, cars, "seen"), "name", "lat", "lon")
    assert got == [("half", 3.0, 4.0), ("own", 9.0, 8.0), ("zero", 3.0, 4.0)]
    forecasts = own.withColumnsRenamed({"lat": "stop_lat", "lon": "stop_lon"})
    assert rows(enrich.anchor_forecasts(forecasts, cars, "seen"), "name", "lat", "lon") == got


def test_vehicle_filters(spark):
    cars = spark.createDataFrame([("bus", "m15", 1.0, 1.0), ("subway", "A", 1.0, 0.0), ("bus", "Q1", 1.0, 1.0)],
                                 "mode string, route_short string, lat double, lon double")
    assert enrich.filter_vehicles(cars, ("bus",), "M15").count() == 1
    assert enrich.filter_vehicles(cars, ()).count() == 0
    assert enrich.mappable(cars).count() == 2


def test_congestion(spark):
    pings = [(f"t{i % 10}", "M1", "STOPPED_AT" if i < 5 else "IN_TRANSIT_TO", at(i)) for i in range(20)]
    pings += [(None, "M1", "STOPPED_AT", at(3)), ("x", "", "STOPPED_AT", at(3)), ("x", None, "STOPPED_AT", at(3)),
              ("y", "M1", "STOPPED_AT", at(60))]
    buses = spark.createDataFrame(pings, "trip_id string, route_short string, current_status string, event_time timestamp_ntz")
    got = sorted(tuple(r) for r in aggregate.corridor_congestion(buses).collect())
    assert got == [("M1", 1, 0, 1, "LIGHT", at(119.999)), ("M1", 10, 15, 6, "HEAVY", at(59.999))]
    once = sorted(tuple(r) for r in aggregate.corridor_congestion(buses, distinct_stopped=True).collect())
    assert once[1][3] == 5


def test_known_routes_sort_by_number(spark):
    cars = spark.createDataFrame(
        [("bus", r, r, 1.0, 1.0) for r in ("M15", "M4", "M100", "Q1A", "M4")] + [("bus", "M9", "M9", 0.0, 1.0), ("subway", "", "A", 1.0, 1.0)],
        "mode string, route_short string, route_id string, lat double, lon double")
    got = [r.route for r in aggregate.known_routes(cars).orderBy("mode", "sort_key").collect()]
    assert got == ["M4", "M15", "M100", "Q1A", "A"]


def test_left_rows_of_one_slice_are_spread(spark):
    """Without keys the shuffle carries a salt; results do not depend on it."""
    left = spark.range(300).selectExpr("id", "TIMESTAMP_NTZ'2024-01-01' + make_interval(0,0,0,0,0,0,id % 7) AS t").unionByName(
        spark.range(1).selectExpr("id", "TIMESTAMP_NTZ'2024-01-01' AS t"))
    right = spark.range(5).selectExpr("id AS r", "TIMESTAMP_NTZ'2024-01-01' + make_interval(0,0,0,0,0,0,id) AS u")
    df = asof_join(left, right, "t", "u", "1 hour")
    assert "_salt" in df._jdf.queryExecution().executedPlan().toString()
    got = rows(df, "id", "r")
    assert got == sorted((i, min(i % 7, 4)) for i in [*range(300), 0])
    assert got == rows(asof_join(left, right, "t", "u", "1 hour", salts=1), "id", "r")
