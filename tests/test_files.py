import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetline import schemas
from fleetline.operators import geometry
from fleetline.sinks import tables as sinks
from fleetline.sources import feeds, files, flatten, static
from helpers import at, rows


def test_stops_file(spark, tmp_path):
    (tmp_path / "stops.txt").write_bytes(
        "﻿stop_id,stop_name,stop_lat,stop_lon\n 101 , Old ,1.5,2.5\n,none,1,1\n102,\"Comma, St\",x,2\n103,,,\n101,New,3.5,4.5\n".encode())
    got = rows(static.read_stops(spark, str(tmp_path / "stops.txt")))
    assert got == [("101", "New", 3.5, 4.5), ("102", "Comma, St", 0.0, 0.0), ("103", "", 0.0, 0.0)]


def test_static_folder(spark, tmp_path):
    (tmp_path / "routes.txt").write_text("route_id,route_color\nA,111111\nA,0039A6\nB,\n,FFFFFF\n")
    (tmp_path / "trips.txt").write_text("route_id,shape_id\nB,long\nA,long\nA,short\nA,\nB,tiny\n")
    (tmp_path / "shapes.txt").write_text(
        "shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\n" + "".join(f"long,{i},{i}.5,7\n" for i in (2, 0, 1))
        + "short,1,1,1\nshort,2,2,2\nshort,3,bad,2\nshort,x,2,2\n,1,1,1\ntiny,,5,5\nlost,1,1,1\n")
    parts = static.read_gtfs_static(spark, str(tmp_path))
    assert parts["shapes"].count() == 7
    trunks = geometry.trunk_shapes(parts["shapes"], parts["trips"])
    assert rows(trunks) == [("A", "short", 2), ("B", "long", 3)]
    lines = geometry.route_shapes(parts["shapes"], parts["trips"], parts["routes"])
    assert rows(lines, "route_id", "color", "position", "lat") == [
        ("A", "#0039A6", 0, 1.0), ("A", "#0039A6", 1, 2.0), ("B", "#888888", 0, 0.5), ("B", "#888888", 1, 1.5), ("B", "#888888", 2, 2.5)]
    feature = json.loads(geometry.to_geojson_features(lines).filter("route_id = 'A'").first().feature)
    assert feature == {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1.0, 1.0], [2.0, 2.0]]},
                       "properties": {"route_id": "A", "route_short": "A", "mode": "subway", "color": "#0039A6", "part": 0}}


def test_equal_shapes_fall_to_the_first_in_the_file(spark, tmp_path):
    (tmp_path / "routes.txt").write_text("route_id,route_color\nA,\n")
    (tmp_path / "trips.txt").write_text("route_id,shape_id\nA,a\nA,z\n")
    (tmp_path / "shapes.txt").write_text("shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\nz,1,1,1\nz,2,2,2\na,1,1,1\na,2,2,2\n")
    parts = static.read_gtfs_static(spark, str(tmp_path))
    assert rows(geometry.trunk_shapes(parts["shapes"], parts["trips"])) == [("A", "z", 2)]
    assert rows(geometry.trunk_shapes(parts["shapes"].drop("point_order"), parts["trips"])) == [("A", "a", 2)]


def test_long_lines_continue_in_parts(spark, tmp_path):
    points = spark.range(11).select(F.lit("R").alias("route_id"), F.lit("#000000").alias("color"), F.col("id").alias("position"),
                                    F.col("id").cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    path = str(tmp_path / "lines")
    sinks.write_features(geometry.to_geojson_features(points, max_points=5), path)
    got = files.read_shapes(spark, path).orderBy("part").collect()
    assert [[c[1] for c in r.coordinates] for r in got] == [[0, 1, 2, 3, 4, 5], [5, 6, 7, 8, 9, 10]]


def test_numbering_matches_sorting(spark):
    data = [("s", (i * 37) % 101, float(i % 3), float(i)) for i in range(300)]
    df = spark.createDataFrame(data, "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double").repartition(4)
    got = geometry.numbered_points(df, band=10).orderBy("position").collect()
    assert [tuple(r)[:4] for r in got] == sorted(data) and [r.position for r in got] == list(range(300))


def test_shape_files_merge(spark, tmp_path):
    def collection(route):
        return json.dumps({"type": "FeatureCollection", "features": [
            {"type": "Feature", "properties": {"route_id": route}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}]}, indent=1)
    (tmp_path / "a_shapes.geojson").write_text(collection("A"))
    (tmp_path / "b_shapes.geojson").write_text(collection("B"))
    (tmp_path / "c_shapes.geojson").write_text("not json")
    (tmp_path / "other.geojson").write_text(collection("X"))
    got = files.read_shapes(spark, str(tmp_path / "*_shapes.geojson"))
    assert rows(got, "route_id", "n_points") == [("A", 2), ("B", 2)]


def test_decisions_file(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text('{"route_id": "1", "headway_seconds": 60}\n\n{broken\n{"route_id": "2"}\n')
    assert rows(files.read_decisions_jsonl(spark, str(path)), "route_id") == [("1",), ("2",)]


def test_payloads(spark):
    framed = bytes([0, 0, 0, 0, 9])
    data = [(b'{"a": "x", "n": 1}', None), (framed + b'{"a": "y"}', b'{"n": 7}'), (framed + b"nope", None), (b"", None),
            (None, None), (b'{"a": "z", "n": 2}', b"raw"), (b"\x00{}", None), (b'{"a": "w"}', framed + b'{"a": "k"}')]
    df = spark.createDataFrame(data, "value binary, key binary")
    schema = schemas.struct(a="string", n="int")
    got = sorted(map(str, (tuple(r) for r in files.decode_payload(df, schema).collect())))
    assert got == ["('k', None)", "('x', 1)", "('y', 7)", "('z', 2)"]


def test_flatten(spark):
    stops = spark.createDataFrame([("101", "Main", 1.0, 2.0)], schemas.STOPS)
    def car(trip="t", route="AB_M1", vehicle="ACME_1", stop="101N", status=1, seq=None, ts=50, pos=(40.0, -73.0, None), direction=None):
        return ("f", 100, ((trip, route, direction), vehicle, stop, status, seq, ts, pos), None)
    def update(trip, calls):
        return ("f", 100, None, ((trip, "1", None), calls))
    feed = spark.createDataFrame(
        [car(), car(trip=""), car(route=""), car(trip="u", ts=0, status=9, stop=None, pos=(0.0, 1.0, 1.0)), car(trip="v", ts=None, pos=None, direction=1),
         update("wS", [("101", 5, None), ("", 5, 5), ("102N", None, 0), ("103", None, 8)])], schemas.FEED)
    got = rows(flatten.flatten_vehicles(feed, stops), "trip_id", "direction", "stop_base", "stop_name", "current_status", "stop_sequence", "event_time")
    early, late = at(50 - 1704067200), at(100 - 1704067200)
    assert got == [("t", "N", "101", "Main", "STOPPED_AT", 0, early), ("u", "U", "", "", "IN_TRANSIT_TO", 0, late),
                   ("v", "N", "101", "Main", "STOPPED_AT", 0, late)]
    got = rows(flatten.flatten_trip_updates(feed, stops), "stop_id", "direction", "arrival_epoch", "departure_epoch", "stop_name")
    assert got == [("101", "S", 5, 0, "Main"), ("103", "S", 0, 8, "")]
    got = rows(flatten.flatten_buses(feed), "trip_id", "route_short", "direction", "bearing")
    assert got == [("AB_M1:ACME_1", "M1", "", -1.0), ("t", "M1", "", -1.0)]
    assert flatten.flatten_buses(feed, "other").count() == 0


def test_feed_selection(spark):
    parts = {k: spark.createDataFrame([(k,)], "k string") for k in "abc"}
    assert rows(feeds.merge_feeds(parts, "a, c,x")) == [("a",), ("c",)]
    for everything in ("all", "", None, "x,y"):
        assert feeds.merge_feeds(parts, everything).count() == 3
    options = feeds.kafka_options("h:1", "t", "latest", maxOffsetsPerTrigger="10")
    assert options["startingOffsets"] == "latest" and options["maxOffsetsPerTrigger"] == "10"


def test_tail(spark):
    assert [r.id for r in feeds.tail_n(spark.range(1000), 3, ("id",)).collect()] == [999, 998, 997]


def test_keyed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    def change(n, data):
        sinks.write_changes(spark.createDataFrame(data, "k string, t long, v string"), path, n, ("k",), "t")
    change(0, [("a", 1, "a1"), ("a", 2, "a2"), ("b", 5, "b5")])
    change(1, [("b", 4, "b4"), ("c", 1, "c1")])
    change(1, [("b", 4, "b4"), ("c", 1, "c1")])
    schema = schemas.struct(k="string", t="long", v="string")
    assert rows(sinks.read_keyed(spark, path, schema, ("k",)), "v") == [("a2",), ("b4",), ("c1",)]
    assert rows(sinks.read_keyed(spark, path, schema, ("k",), "t"), "v") == [("a2",), ("b5",), ("c1",)]
    assert sinks.has_change(spark, path, 1) and not sinks.has_change(spark, path, 2)
    sinks.compact(spark, path, schema, ("k",), "t")
    now = sinks.read_keyed(spark, path, schema, ("k",), "t")
    assert rows(now, "v") == [("a2",), ("b5",), ("c1",)]
    assert all("/_compacted/0-1/" in f for f in now.inputFiles())
    change(2, [("a", 1, "old"), ("c", 7, "c7")])
    assert rows(sinks.read_keyed(spark, path, schema, ("k",), "t"), "v") == [("a2",), ("b5",), ("c7",)]
    sinks.compact(spark, path, schema, ("k",), "t")
    assert rows(sinks.read_keyed(spark, path, schema, ("k",), "t"), "v") == [("a2",), ("b5",), ("c7",)]


def test_folders_of_a_thousand_changes():
    folds = set()
    for number in range(1001):
        count = sinks.FOLD
        while count <= number:
            last = number // count * count - 1
            folds.add((last - count + 1, last))
            count *= sinks.FOLD
        live = sinks.live_folders(range(number), sorted(folds), lambda f: True)
        held = [c for f in live for c in (range(f[0], f[1] + 1) if isinstance(f, tuple) else (f,))]
        assert sorted(held) == list(range(number)) and len(live) <= 20


@given(st.sets(st.integers(0, 40)), st.sets(st.tuples(st.integers(0, 40), st.integers(0, 40)).filter(lambda f: f[0] <= f[1])),
       st.integers(0, 7))
def test_folders_hold_each_change_once(changes, folds, broken):
    live = sinks.live_folders(sorted(changes), sorted(folds), lambda f: sum(f) % 7 != broken)
    held = [c for f in live for c in changes if (f[0] <= c <= f[1] if isinstance(f, tuple) else c == f)]
    assert sorted(held) == sorted(changes)
    assert all(not isinstance(f, tuple) or (f in folds and sum(f) % 7 != broken) for f in live)


def test_folded_changes(spark, tmp_path):
    """Folds of four and sixteen, with a missing change, a replayed last one, and a compaction across their borders."""
    path, schema, newest = str(tmp_path / "t"), schemas.struct(k="string", t="long", v="string"), {}

    def check(most):
        now = sinks.read_keyed(spark, path, schema, ("k",), "t")
        assert rows(now, "k", "v") == sorted((k, v) for k, (_, v) in newest.items())
        assert len({f.rsplit("/", 1)[0] for f in now.inputFiles()}) <= most

    def change(n, t):
        data = [(f"k{n % 5}", t, f"v{n}"), (f"own{n}", t, f"v{n}")]
        sinks.fold_changes(spark, path, schema, ("k",), n, "t")
        sinks.write_changes(spark.createDataFrame(data, schema).coalesce(1), path, n, ("k",), "t")
        for k, t, v in data:
            newest[k] = max(newest.get(k, (-1, "")), (t, v))

    assert sinks.stored_changes(spark, path, schema).count() == 0
    for n in range(18):
        if n != 6:
            change(n, 100 - n if n % 3 else 100 + n)
    assert {p.name for p in (tmp_path / "t" / "_compacted").iterdir()} == {"0-3", "4-7", "8-11", "12-15", "0-15"}
    check(3)
    change(17, 83)
    check(3)
    sinks.compact(spark, path, schema, ("k",), "t")
    check(1)
    for n in range(18, 22):
        change(n, 200 + n)
    check(5)


def test_buckets(spark, tmp_path):
    path = str(tmp_path / "b")
    sinks.write_bucketed(spark.range(100).withColumn("k", F.col("id") % 7).repartition(5), path, ("k",))
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.select("k", "bucket").distinct().count() == 7
    assert back.agg(F.max("bucket")).first()[0] <= 2


def test_start_of_each_table(spark):
    df = spark.range(1000)
    assert feeds.starting_rows(df, "headway_alerts", ("id",)).count() == 1000
    assert rows(feeds.starting_rows(df, "arrival_estimates", ("id",)))[0] == (750,)
    assert feeds.starting_rows(df, "vehicle_positions", ("id",)).count() == 0
    options = feeds.kafka_options("h:1", "t", feeds.start_policy("arrival_estimates"), ends={0: 1000, 1: 10})
    assert json.loads(options["startingOffsets"]) == {"t": {"0": 750, "1": 0}}
    with pytest.raises(ValueError):
        feeds.starting_offsets("tail")
