"""Change logs, mergeable counts and models on streams, against plain searches and the operators of tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetline.operators import models
from fleetline.operators.aggregate import corridor_congestion
from fleetline.operators.rollup import congestion_rollup, rollup_congestion, widen_rollup
from fleetline.sinks import tables as sinks
from fleetline.streaming import changes, headways, runs
from helpers import at, rows
from test_streaming import landed

PINGS = "trip string, stop string, route string, load long, ts timestamp_ntz"
KEYS = ("trip", "stop")


def pings(n, seed):
    """Distinct times in order, some keys and routes null."""
    rnd = random.Random(seed)
    times = sorted(rnd.sample(range(100_000), n))
    return [(rnd.choice(["a", "b", "c", None]), rnd.choice(["x", "y"]), rnd.choice(["1", "2", None]), rnd.randrange(9), at(t)) for t in times]


def settled_counts(data, horizon):
    """Newest rows of each key and of each run of it without a pause longer than `horizon`, by plain search."""
    last, kept = {}, []
    for row in data:
        known = last.get(row[:2])
        if known is not None and (row[4] - kept[known][4]).total_seconds() <= horizon:
            kept[known] = row
        else:
            last[row[:2]] = len(kept)
            kept.append(row)
    loads = Counter()
    for row in kept:
        loads[row[2]] += row[3]
    counts = Counter(row[2] for row in kept)
    return sorted(((k, n, loads[k]) for k, n in counts.items()), key=str)


def logged(spark, folder, batches, horizon):
    end = [("end", "end", "end", 0, at(10_000_000))]
    stream = landed(spark, f"{folder}/in", [*batches, end], spark.createDataFrame([], PINGS).schema)
    runs.finish(changes.change_log_stream(stream, KEYS, "ts", f"{folder}/out", f"{folder}/ck", horizon=f"{horizon} seconds", width="1 day"))
    log = changes.read_change_log(spark, f"{folder}/out", stream.schema, KEYS)
    return log, sorted(map(tuple, changes.sums_of_log(log, KEYS, ("route",), ("load",)).collect()), key=str)


@pytest.mark.parametrize("horizon", [3_000, 200_000])
def test_sums_of_a_change_log_do_not_depend_on_batches(spark, tmp_path, monkeypatch, horizon):
    monkeypatch.setattr(changes, "FOLD_EVERY", 2)
    data = pings(150, horizon)
    want = settled_counts(data, horizon)
    _, one = logged(spark, tmp_path / "one", [data], horizon)
    cuts = [data[i:i + 30] for i in range(0, 150, 30)]
    log, many = logged(spark, tmp_path / "many", cuts, horizon)
    assert one == many == want
    assert sinks.child_names(spark, f"{tmp_path}/many/out/log/_compacted")
    # A row without one before it begins a run of its key; the others are corrections.
    assert log.filter("before IS NULL").count() == sum(n for _, n, _ in want)
    assert log.filter("before IS NOT NULL").count() > 0


def test_a_correction_moves_a_row_between_groups(spark, tmp_path):
    batches = [[("a", "x", "1", 5, at(0)), ("b", "x", "1", 7, at(1))], [("a", "x", "2", 6, at(100))], [("b", "x", "2", 1, at(200))]]
    log, sums = logged(spark, tmp_path, batches, 1000)
    assert sums == [("2", 2, 7)]  # no row of route 1 is left, so it is not returned
    moved = log.filter("before IS NOT NULL").select("trip", "before.route", "before.load", F.col("after.route").alias("to"))
    assert rows(moved) == [("a", "1", 5, "2"), ("b", "1", 7, "2")]


BUSES = "trip_id string, route_short string, current_status string, event_time timestamp_ntz"


def test_small_groups_of_a_rollup_are_exact(spark):
    rnd = random.Random(3)
    data = [(rnd.choice([None, *map(str, range(40))]), rnd.choice(["M1", "M2", "", None]), rnd.choice(["STOPPED_AT", "IN_TRANSIT_TO", None]),
             at(rnd.randrange(100_000))) for _ in range(2000)]
    buses = spark.createDataFrame(data, BUSES)
    minutes = congestion_rollup(buses)
    assert minutes.count() > 500
    hours = widen_rollup(minutes, "1 hour")
    for distinct in (False, True):
        assert rows(rollup_congestion(hours, distinct)) == rows(corridor_congestion(buses, "1 hour", distinct_stopped=distinct))
        assert rows(rollup_congestion(widen_rollup(hours, "1 day"), distinct)) == rows(corridor_congestion(buses, "1 day", distinct_stopped=distinct))
    assert rollup_congestion(widen_rollup(congestion_rollup(buses.limit(0)), "1 hour")).count() == 0


def test_large_groups_of_a_rollup_are_near(spark):
    """A vehicle has a ping in each of four hours, so hours of 90,000 vehicles share most of them with the day."""
    buses = spark.range(360_000).select(
        F.concat(F.lit("t"), (F.col("id") % 90_000 + F.floor(F.col("id") / 90_000) * 10_000).cast("string")).alias("trip_id"),
        F.lit("M1").alias("route_short"), F.lit("STOPPED_AT").alias("current_status"),
        (F.lit(at(0)).cast("timestamp_ntz") + F.make_interval(hours=F.floor(F.col("id") / 90_000).cast("int"))).alias("event_time"))
    hours = widen_rollup(congestion_rollup(buses), "1 hour")
    for r in rollup_congestion(hours).collect():
        assert abs(r.active_buses / 90_000 - 1) <= 0.02 and r.stopped_buses == 90_000
    day = rollup_congestion(widen_rollup(hours, "1 day"), distinct_stopped=True).first()
    assert abs(day.active_buses / 120_000 - 1) <= 0.02 and abs(day.stopped_buses / 120_000 - 1) <= 0.02
    assert day.in_transit_buses == 0 and day.congestion_level == "HEAVY"


def test_stretches_that_share_a_window_merge(spark, tmp_path):
    data = [(f"t{i % 7}", "M1", "STOPPED_AT", at(20 * i)) for i in range(60)]
    stream = landed(spark, str(tmp_path / "in"), [data[:17], data[17:41], data[41:], [("end", "-", None, at(90_000))]],
                    spark.createDataFrame([], BUSES).schema)
    runs.finish(changes.congestion_rollup_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "1 hour", width="1 day"))
    parts = changes.read_rollup(spark, f"{tmp_path}/out", stream.schema)
    assert parts.count() > 1
    assert rows(rollup_congestion(widen_rollup(parts, "1 hour"))) == rows(corridor_congestion(spark.createDataFrame(data, BUSES), "1 hour"))


def test_models_of_a_stream_equal_those_of_tables(spark, tmp_path):
    rnd = random.Random(11)
    times = sorted(rnd.sample(range(500_000), 240))
    data = [("1", "N", rnd.choice(["s1", "s2"]), "Stop", 40.0, -73.0, f"p{i}", f"c{i}", rnd.choice([300, 310, 290, 305, 2000 if i > 100 else 300]),
             at(t)) for i, t in enumerate(times)]
    table = spark.createDataFrame(data, headways.HEADWAYS)
    end = [(None,) * 8 + (0, at(10_000_000))]
    stream = landed(spark, str(tmp_path / "in"), [data[i:i + 50] for i in range(0, 240, 50)] + [end], headways.HEADWAYS)
    runs.finish(changes.model_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", max_n=20, width="1 day"))
    found = changes.read_anomalies(spark, f"{tmp_path}/out")
    assert rows(found) == rows(models.anomaly_alerts(table, max_n=20)) and found.count() > 0
    ahead = changes.read_trends(spark, f"{tmp_path}/out").drop("prev_headway_seconds")
    assert rows(ahead) == rows(models.trend_forecasts(table, max_n=20).drop("prev_headway_seconds")) and ahead.count() > 0
    # The ring holds twenty rows a stop whatever came before.
    ring = sinks.read_keyed(spark, f"{tmp_path}/out/ring", changes.RING, ("route_id", "direction", "stop_id", "rank"))
    assert ring.groupBy("stop_id").count().agg(F.max("count")).first()[0] == 20
