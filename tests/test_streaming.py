import os
import random

import pandas as pd
import pytest

from fleetline import schemas
from fleetline.operators.agent import dispatcher_decisions
from fleetline.operators.aggregate import corridor_congestion
from fleetline.operators.dedup import ALERT_IDENTITY
from fleetline.operators.enrich import weather_impact
from fleetline.operators.sequence import headway, headway_forecast
from fleetline.operators.snapshot import latest_state
from fleetline.plans import jobs
from fleetline.sinks import tables as sinks
from fleetline.sources import feeds
from fleetline.streaming import events, headways, joins, runs, slices
from helpers import ALERTS, START, alert, at, rows


def position(trip, seconds, stop="101N", status="STOPPED_AT"):
    return (trip, "1", "N", stop, "101", "Main", 40.0, -73.0, status, 1, at(seconds))


def landed(spark, folder, batches, schema):
    """One file per batch, read one file at a time in the order written."""
    for i, batch in enumerate(batches):
        path = f"{folder}/b{i:03d}"
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (START.timestamp() + i, START.timestamp() + i))
    return feeds.read_feed(spark, f"{folder}/*", schema, stream=True, maxFilesPerTrigger="1")


def out_of_order(n, seed, lateness=25):
    rnd = random.Random(seed)
    data = [position(f"t{rnd.randrange(n // 3)}", rnd.randrange(20000) + i / 1000, rnd.choice(["101N", "102N"])) for i in range(n)]
    data.sort(key=lambda r: r[-1].timestamp() + rnd.uniform(0, lateness))
    return data


@pytest.fixture()
def moving(spark, tmp_path):
    data = out_of_order(240, 7)
    data.append(position("end", 30000, "999"))
    batches = [data[i:i + 60] for i in range(0, len(data), 60)]
    return landed(spark, str(tmp_path / "in"), batches, schemas.VEHICLE_POSITIONS), spark.createDataFrame(data, schemas.VEHICLE_POSITIONS)


def matched(stream, folder, **options):
    runs.finish(headways.headway_stream(stream, f"{folder}/out", f"{folder}/ck", **options))
    return headways.read_headways(stream.sparkSession, f"{folder}/out")


def test_headways_and_forecasts_equal_batch(spark, moving, tmp_path):
    stream, table = moving
    got = matched(stream, tmp_path, width="1 day")
    arrivals = jobs.first_arrivals(table).filter("stop_id <> '999'")
    assert rows(got) == rows(headway(arrivals)) and got.count() > 50
    assert rows(headways.read_arrivals(spark, f"{tmp_path}/out")) == rows(arrivals.select(*headways.ARRIVALS.names))
    ahead = headways.read_forecasts(spark, f"{tmp_path}/out")
    assert rows(ahead) == rows(headway_forecast(arrivals)) and ahead.count() > 0


def test_folded_tables_give_the_same_headways(spark, moving, tmp_path, monkeypatch):
    monkeypatch.setattr(headways, "FOLD_EVERY", 2)
    stream, table = moving
    got = matched(stream, tmp_path, width="1 day")
    assert rows(got) == rows(headway(jobs.first_arrivals(table).filter("stop_id <> '999'")))
    assert sinks.child_names(spark, f"{tmp_path}/out/seen/_compacted")


def test_late_rows_are_dropped(spark, tmp_path):
    batches = [[position("a", 0), position("b", 100)], [position("c", 500)], [position("late", 50), position("d", 700)],
               [position("end", 9000, "999")]]
    stream = landed(spark, str(tmp_path / "in"), batches, schemas.VEHICLE_POSITIONS)
    got = matched(stream, tmp_path)
    assert rows(got, "prev_trip", "curr_trip", "headway_seconds") == [("a", "b", 100), ("b", "c", 400), ("c", "d", 200)]


def test_trips_return_after_the_horizon(spark, tmp_path):
    batches = [[position("a", 0), position("b", 100)], [position("a", 200), position("c", 4000)], [position("a", 8000)],
               [position("end", 20000, "999")]]
    stream = landed(spark, str(tmp_path / "in"), batches, schemas.VEHICLE_POSITIONS)
    got = matched(stream, tmp_path, horizon="1 hour")
    assert rows(got, "prev_trip", "curr_trip") == [("a", "b"), ("b", "c"), ("c", "a")]


def test_matching_goes_on_in_a_resumed_run(spark, tmp_path):
    """What waited in the first run is matched in the second, and a batch that runs again changes nothing."""
    schema = schemas.VEHICLE_POSITIONS
    for part, batch in enumerate([[position("a", 0), position("b", 100), position("c", 160)], [position("d", 300), position("a", 310)],
                                  [position("end", 9000, "999")]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        got = rows(matched(stream, tmp_path), "prev_trip", "curr_trip")
        assert got == [[("a", "b")], [("a", "b"), ("b", "c")], [("a", "b"), ("b", "c"), ("c", "d")]][part]
    pending = spark.read.parquet(f"{tmp_path}/out/pending")
    assert pending.count() == 6 and matched(stream, tmp_path).count() == 3


def test_matching_has_no_state_in_python(spark, moving, tmp_path):
    stream, _ = moving
    query = headways.headway_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", width="1 day")
    runs.finish(query)
    assert "State" not in query._jsq.explainInternal(False) and "Python" not in query._jsq.explainInternal(False)


def test_an_unfinished_batch_is_not_seen_when_it_runs_again(spark, tmp_path):
    batches = [[position("a", 0), position("b", 100)], [position("c", 500)], [position("end", 9000, "999")]]
    stream = landed(spark, str(tmp_path / "in"), batches, schemas.VEHICLE_POSITIONS)
    want = rows(matched(stream, tmp_path))
    last = max(int(n.split("=")[1]) for n in sinks.child_names(spark, f"{tmp_path}/out/marks") if "=" in n)
    for name in os.listdir(f"{tmp_path}/out/marks/change={last}"):
        os.remove(f"{tmp_path}/out/marks/change={last}/{name}")
    for name in (f"commits/{last}", f"commits/.{last}.crc"):
        if os.path.exists(f"{tmp_path}/ck/{name}"):
            os.remove(f"{tmp_path}/ck/{name}")
    assert rows(matched(stream, tmp_path)) == want and len(want) == 2


WEATHER = "event_time timestamp_ntz, current struct<temperature_2m: double, precipitation: double, wind_speed_10m: double, weather_code: int>"


def test_weather_on_a_stream_keeps_equal_alerts_apart(spark, tmp_path):
    rnd = random.Random(8)
    alerts = sorted((alert(rnd.randrange(20_000), curr=f"c{rnd.randrange(3)}") for _ in range(60)), key=lambda a: a[-1])
    alerts += [alerts[30], alerts[30]]
    weather = [(at(rnd.randrange(20_000)), (float(i), 0.0, 1.0, i)) for i in range(40)]
    end = [alert(90_000)], [(at(190_000), (0.0, 0.0, 0.0, 0))]
    left = landed(spark, str(tmp_path / "a"), [alerts[:20], alerts[20:], end[0]], spark.createDataFrame([], ALERTS).schema)
    right = landed(spark, str(tmp_path / "w"), [weather, end[1]], spark.createDataFrame([], WEATHER).schema)
    runs.finish(joins.weather_impact_stream(left, right, f"{tmp_path}/out", f"{tmp_path}/ck", width="1 day"))
    late = alerts[:20] + sorted(alerts[20:], key=lambda a: a[-1])
    want = weather_impact(spark.createDataFrame(late, ALERTS), spark.createDataFrame(weather, WEATHER))
    got = slices.read_closed(spark, f"{tmp_path}/out/joined", want.schema)
    assert rows(got) == rows(want) and want.count() > 40
    assert spark.read.parquet(f"{tmp_path}/out/pending").count() == len(alerts) + len(weather) + 2


def test_states_expire(spark, tmp_path):
    schema, keys = schemas.struct(k="string", t="time", v="long"), ("k",)
    batches = [[("a", at(0), 1), ("b", at(50), 2)], [("a", at(40), 3), ("a", at(30), 9)], [("b", at(200), 4)], [("c", at(400), 5)]]
    want = [[("a", 1)], [("a", 1)], [("a", 3), ("b", 2)], [("b", 4)]]
    for part, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        runs.finish(joins.latest_state_stream(stream, slices.micros("t"), keys, "t", 200, f"{tmp_path}/out", f"{tmp_path}/ck", delay="30 seconds"))
        got = joins.read_latest_state(spark, f"{tmp_path}/out", schema, keys)
        mark = max(t for b in batches[:part + 1] for _, t, _ in b).timestamp() - START.timestamp() - 30
        table = latest_state(spark.createDataFrame([r for b in batches[:part + 1] for r in b], schema), keys, "t", 200, at(mark))
        assert rows(got, "k", "v") == rows(table, "k", "v") == want[part]


def test_first_rows_by_event_time(spark, tmp_path):
    schema = schemas.struct(k="string", event_time="time", v="long")
    batches = [[("a", at(20), 1), ("b", at(25), 2)], [("a", at(10), 3), ("b", at(70), 4)], [("a", at(300), 5), (None, at(310), 6)], [("z", at(900), 7)]]
    stream = landed(spark, str(tmp_path / "in"), batches, schema)
    runs.finish(joins.first_rows_stream(stream, ("k",), "event_time", f"{tmp_path}/out", f"{tmp_path}/ck"))
    got = slices.read_closed(spark, f"{tmp_path}/out/first", schema)
    assert sorted(((r.k, r.v) for r in got.collect()), key=str) == [("a", 3), ("b", 2), (None, 6)]


def test_congestion_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    data = [(f"t{rnd.randrange(15)}", "M1", rnd.choice(["M1", "M2", ""]), "0", "", 1.0, 1.0, None,
             rnd.choice(["STOPPED_AT", "IN_TRANSIT_TO"]), at(i + rnd.uniform(0, 20))) for i in range(400)]
    data.append(("end", "Z", "Z", "0", "", 1.0, 1.0, None, "STOPPED_AT", at(5000)))
    stream = landed(spark, str(tmp_path / "in"), [data[i:i + 100] for i in range(0, 401, 100)], schemas.BUS_POSITIONS)
    got = runs.run_append(events.corridor_congestion_stream(events.with_feed_watermark(stream)))
    expected = corridor_congestion(spark.createDataFrame(data, schemas.BUS_POSITIONS)).filter("route_short <> 'Z'")
    assert rows(got) == rows(expected)


def test_latest_rows_replace(spark, tmp_path):
    schema = schemas.struct(k="string", t="zoned", v="long")
    batches = [[("a", at(1), 1), ("b", at(9), 2)], [("a", at(5), 3), ("b", at(3), 4)]]
    for label, mode in (("state", "update"), ("plain", "append")):
        stream = landed(spark, str(tmp_path / label), batches, schema)
        if mode == "update":
            stream = events.dedup_last_stream(stream, ("k",), "t")
        assert rows(runs.run_upsert(stream, ("k",), "t", output_mode=mode), "k", "v") == [("a", 3), ("b", 2)]


def test_estimates_follow_the_newest_prediction(spark, tmp_path):
    now = 1704067200
    def update(trip, epoch, seconds):
        return (trip, "1", "N", "s", "s", "Main", 1.0, 1.0, epoch, 0, at(seconds))
    batches = [[update("stays", now + 60, 1), update("leaves", now + 60, 1), update("none", 0, 1)],
               [update("leaves", now + 5000, 2), update("stays", 0, 3), update("late", now + 9, 0)], [update("late", now + 70, -5)]]
    stream = landed(spark, str(tmp_path / "in"), batches, schemas.TRIP_UPDATES)
    runs.finish(runs.predictions_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck"))
    assert rows(runs.read_arrival_estimates(spark, f"{tmp_path}/out", now), "trip_id", "eta_seconds") == [("late", 9), ("stays", 60)]
    assert rows(runs.read_arrival_estimates(spark, f"{tmp_path}/out", now + 4000), "trip_id", "eta_seconds") == [("leaves", 1000)]


def test_first_rows(spark, tmp_path):
    schema = schemas.struct(k="string", event_time="zoned")
    batches = [[("a", at(1)), ("a", at(2))], [("a", at(3)), ("b", at(4))]]
    for bounded in (True, False):
        stream = landed(spark, str(tmp_path / str(bounded)), batches, schema).withWatermark("event_time", "1 minute")
        assert rows(runs.run_append(events.dedup_first_stream(stream, ("k",), bounded)), "k") == [("a",), ("b",)]


def test_decisions_once_per_alert(spark, tmp_path):
    schema = spark.createDataFrame([], ALERTS).schema
    first, again = [alert(10, "BUNCHING", 50), alert(20, curr="d")], [alert(10, "BUNCHING", 50), alert(30, curr="e")]
    calls = spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(len(prompts))
        return pd.Series(["Action: MONITOR"] * len(prompts))

    def run():
        stream = feeds.read_feed(spark, f"{tmp_path}/in/*", schema, stream=True, maxFilesPerTrigger="1")
        runs.finish(runs.dispatcher_stream(events.with_alert_watermark(stream), f"{tmp_path}/out", f"{tmp_path}/ck", model))

    landed(spark, str(tmp_path / "in"), [first, again], schema)
    run()
    asked = calls.value
    run()
    decisions = sinks.read_keyed(spark, f"{tmp_path}/out", dispatcher_decisions(spark.createDataFrame([], ALERTS)).schema, ALERT_IDENTITY)
    assert rows(decisions, "curr_trip", "action") == [("c", "HOLD TRAIN"), ("d", "MONITOR"), ("e", "MONITOR")]
    assert asked == 3 and calls.value == asked


def test_an_identity_is_asked_once_over_resumed_runs(spark, tmp_path):
    """The same pair again after the watermark has long passed: one call, the first answer stays."""
    schema = spark.createDataFrame([], ALERTS).schema
    calls = spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(len(prompts))
        return pd.Series([f"Action: MONITOR\nRider Message: {p.split('Observed Headway: ')[1].split()[0]}" for p in prompts])

    for turn, data in enumerate([[alert(8 * 3600, prev="A", curr="B", headway=1000)], [alert(12 * 3600, prev="C", curr="D")],
                                 [alert(13 * 3600, prev="A", curr="B", headway=2000), alert(13 * 3600, prev=None, curr="B")],
                                 [alert(19 * 3600, prev=None, curr="B")]]):
        spark.createDataFrame(data, ALERTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{turn}")
        stream = feeds.read_feed(spark, f"{tmp_path}/in/*", schema, stream=True)
        runs.finish(runs.dispatcher_stream(events.with_alert_watermark(stream), f"{tmp_path}/out", f"{tmp_path}/ck", model))
    assert calls.value == 2  # an alert without its leading trip has no prompt
    decisions = sinks.read_keyed(spark, f"{tmp_path}/out", dispatcher_decisions(spark.createDataFrame([], ALERTS)).schema, ALERT_IDENTITY)
    assert decisions.count() == 3
    assert rows(decisions.filter("curr_trip = 'B' AND prev_trip = 'A'"), "headway_seconds") == [(1000,)]


def test_append_resumes_from_its_checkpoint(spark, tmp_path):
    schema = schemas.struct(k="string", event_time="zoned")
    out, check = f"{tmp_path}/out", f"{tmp_path}/ck"
    stream = landed(spark, str(tmp_path / "in"), [[("a", at(1))], [("b", at(2))]], schema)
    for _ in range(2):
        runs.finish(sinks.append_sink(stream, out, check))
    assert rows(spark.read.parquet(out), "k") == [("a",), ("b",)]


def test_streams_have_declared_schemas(spark, tmp_path):
    for reader, name in ((feeds.read_vehicle_positions, "vp"), (feeds.read_trip_updates, "tu"), (feeds.read_bus_positions, "bus"),
                         (feeds.read_passenger_surges, "ps"), (feeds.read_service_alerts, "sa"), (feeds.read_weather_events, "wx")):
        (tmp_path / name).mkdir()
        assert reader(spark, str(tmp_path / name), stream=True).isStreaming


def test_unparsed_weather_time(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"current": {"time": "2024-01-01T00:15", "weather_code": 3}}\n{"current": {"time": "soon"}}\n')
    got = feeds.read_weather_events(spark, str(tmp_path / "w.json")).select("event_time", "current.weather_code").collect()
    assert got[0].event_time == at(900) and got[1].event_time is None
