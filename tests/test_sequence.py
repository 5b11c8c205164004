import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetline.operators import models
from fleetline.operators.dedup import dedup_alerts, dedup_first, dedup_last, latest_service_alerts, top_per_group
from fleetline.operators.sequence import (
    STOP_KEYS, headway, headway_forecast, headway_triplets, match_consecutive, slice_window, with_carried_rows,
    without_carried_rows)
from fleetline.plans import jobs
from helpers import ALERTS, ARRIVALS, alert, arrival, at, rows


def by_key(data):
    groups = {}
    for r in data:
        groups.setdefault((r[1], r[2], r[3]), []).append(r)
    return [sorted(g, key=lambda r: (r[7], r[0])) for g in groups.values()]


def plain_headways(data):
    out = []
    for g in by_key(data):
        for a, b in zip(g, g[1:]):
            if a[0] != b[0]:
                out.append((a[0], b[0], int((b[7] - a[7]).total_seconds())))
    return sorted(out)


def plain_triplets(data):
    out = []
    for g in by_key(data):
        for a, b, c in zip(g, g[1:], g[2:]):
            if a[0] != b[0] and b[0] != c[0]:
                now, before = int((c[7] - b[7]).total_seconds()), int((b[7] - a[7]).total_seconds())
                out.append((c[0], now, before, 2 * now - before))
    return sorted(out)


def random_arrivals(n, seed, days=4):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        busy = rnd.random() < 0.5
        out.append(arrival(f"t{rnd.randrange(n // 2)}", rnd.randrange(days * 86400) + rnd.random(),
                           stop="hot" if busy else f"s{rnd.randrange(12)}"))
    return out


def test_headway_matches_plain_pairs(spark):
    data = random_arrivals(600, 1)
    df = spark.createDataFrame(data, ARRIVALS).repartition(5)
    for width in ("1 minute", "1 hour", "30 days", "7 days"):
        assert rows(headway(df, width=width), "prev_trip", "curr_trip", "headway_seconds") == plain_headways(data)


def test_triplets_match_plain_triplets(spark):
    data = random_arrivals(500, 2)
    df = spark.createDataFrame(data, ARRIVALS).repartition(5)
    for width in ("10 minutes", "6 hours"):
        got = rows(headway_triplets(df, width=width), "curr_trip", "headway_seconds", "prev_headway_seconds", "predicted_headway")
        assert got == plain_triplets(data)


def test_pairs_cross_empty_slices_and_equal_times(spark):
    data = [arrival("a", 0), arrival("b", 0), arrival("c", 9 * 3600), arrival("c", 10 * 3600), arrival("d", 20 * 3600)]
    got = rows(headway(spark.createDataFrame(data, ARRIVALS)), "prev_trip", "curr_trip", "headway_seconds")
    assert got == [("a", "b", 0), ("b", "c", 32400), ("c", "d", 36000)]


@pytest.mark.parametrize("back", [3, 7])
@pytest.mark.parametrize("width", ["2 minutes", "1 hour", "7 days"])
def test_rows_before_a_slice_are_carried_over_sparse_slices(spark, back, width):
    data = random_arrivals(400, 9) + [arrival("n1", 5, route=None), arrival("n2", 95, route=None)]
    df = spark.createDataFrame(data, ARRIVALS)
    order = ("event_time", "trip_id")
    padded = with_carried_rows(df, STOP_KEYS, order, back, width)
    w = slice_window(STOP_KEYS, order)
    got = without_carried_rows(padded.withColumn("earlier", F.lag("trip_id", back).over(w)))
    plain = df.withColumn("earlier", F.lag("trip_id", back).over(Window.partitionBy(*STOP_KEYS).orderBy(*order)))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_null_trip_never_matches(spark):
    data = [arrival("a", 0), arrival(None, 60), arrival("b", 120)]
    assert headway(spark.createDataFrame(data, ARRIVALS)).count() == 0


def test_forecast_bounds(spark):
    data = [arrival(t, s) for t, s in (("a", 0), ("b", 300), ("c", 500), ("d", 1300), ("e", 1300 + 800))]
    got = rows(headway_forecast(spark.createDataFrame(data, ARRIVALS)), "curr_trip", "predicted_headway", "forecast_type")
    assert got == [("c", 100, "PREDICTED_BUNCHING"), ("d", 1400, "PREDICTED_GAP")]


def test_match_without_conditions_needs_all_rows(spark):
    df = spark.createDataFrame([(1, at(i), i) for i in range(5)], "k int, ts timestamp_ntz, v int")
    got = match_consecutive(df, ("k",), ("ts",), ("A", "B", "C"), {},
                            {"first": lambda m: m["A"]("v"), "last": lambda m: m["C"]("v")}, "1 second")
    assert rows(got) == [(1, 0, 2), (1, 1, 3), (1, 2, 4)]


def test_first_arrival_and_latest_prediction(spark):
    frames = [("t", "1", "N", "s", "S", 1.0, 1.0, status, at(i)) for i, status in
              enumerate(["IN_TRANSIT_TO", "STOPPED_AT", "STOPPED_AT"])]
    positions = spark.createDataFrame(
        frames + [frames[1][:7] + ("STOPPED_AT", at(86400))],
        "trip_id string, route_id string, direction string, stop_id string, stop_name string, stop_lat double, "
        "stop_lon double, current_status string, event_time timestamp_ntz")
    assert [r.event_time for r in jobs.first_arrivals(positions).collect()] == [at(1)]
    assert jobs.first_arrivals(positions, service_date=True).count() == 2

    now = 1704067200
    updates = [("t", "1", "N", "s", "S", 1.0, 1.0, epoch, at(i)) for i, epoch in enumerate([now + 50, now + 70, 0])]
    extra = [(f"e{d}", "1", "N", "s", "S", 1.0, 1.0, now + d, at(0)) for d in (-31, -30, 1800, 1801)]
    table = spark.createDataFrame(
        updates + extra, "trip_id string, route_id string, direction string, stop_id string, stop_name string, "
        "stop_lat double, stop_lon double, arrival_epoch long, event_time timestamp_ntz")
    got = rows(jobs.arrival_estimates(table, now), "trip_id", "eta_seconds")
    assert got == [("e-30", -30), ("e1800", 1800), ("t", 70)]


def test_alerts_keep_only_outliers(spark):
    headways = spark.createDataFrame([alert(i, headway=h)[:9] + (at(i),) for i, h in enumerate([149, 150, 900, 901])],
                                     ALERTS.replace("alert_type string, severity string, ", ""))
    assert rows(jobs.headway_alerts(headways), "headway_seconds", "alert_type", "severity") == [
        (149, "BUNCHING", "MEDIUM"), (901, "GAP", "MEDIUM")]


def test_dedup(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("j", 5, "d")], "k string, t int, v string")
    assert rows(dedup_first(df, ["k"], "t", ("v",)), "v") == [("a",), ("d",)]
    assert rows(dedup_last(df, ["k"], "t", ("v",)), "v") == [("c",), ("d",)]
    assert rows(top_per_group(df, ["k"], ["t", "v"], 2, rank="n"), "v", "n") == [("a", 1), ("b", 2), ("d", 1)]
    alerts = spark.createDataFrame([alert(5), alert(3), alert(4, kind="NORMAL"), alert(9, curr="x")], ALERTS)
    assert rows(dedup_alerts(alerts), "arrival_time") == [(at(3),), (at(9),)]


def test_latest_service_alert(spark):
    df = spark.createDataFrame(
        [(f"a{i}", "e", str(i), "AG", "A | B", "delays", f"h{i}", "d", date) for i, date in enumerate([10, 30, 20])],
        "alert_id string, event_id string, update_number string, agency string, affected string, "
        "status_label string, header string, description string, date long")
    assert [r.header for r in latest_service_alerts(df).collect()] == ["h1"]


def plain_bounds(values, min_n=12, max_n=100):
    import statistics
    out = []
    for i in range(len(values)):
        before = values[max(0, i - max_n):i]
        if len(before) < min_n:
            out.append(None)
            continue
        spread = 2.5758293035489004 * statistics.stdev(before)
        out.append((statistics.mean(before) - spread, statistics.mean(before) + spread))
    return out


def test_anomaly_bounds_across_slices(spark):
    rnd = random.Random(3)
    values = [rnd.randrange(100, 900) for _ in range(260)]
    data = [alert(i * 600, headway=v, curr=f"c{i:04d}")[:9] + (at(i * 600),) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, ALERTS.replace("alert_type string, severity string, ", ""))
    expected = plain_bounds(values)
    for options in ({"width": "1 hour"}, {"width": "1 day"}, {"width": "3 hours"}, {}):
        got = models.detect_anomalies(df, **options).orderBy("arrival_time").collect()
        assert len(got) == len(values)
        for row, bounds in zip(got, expected):
            if bounds is None:
                assert row.lower_bound is None and not row.is_anomaly
            else:
                assert abs(row.lower_bound - bounds[0]) < 1e-5 and abs(row.upper_bound - bounds[1]) < 1e-5
                assert row.is_anomaly == (not bounds[0] <= row.headway_seconds <= bounds[1])


def test_trend_follows_a_line(spark):
    data = [alert(i * 600, headway=100 + 7 * i, curr=f"c{i:04d}")[:9] + (at(i * 600),) for i in range(150)]
    df = spark.createDataFrame(data, ALERTS.replace("alert_type string, severity string, ", ""))
    got = models.forecast_next(df, width="6 hours").orderBy("arrival_time").collect()
    assert [r.forecast_value for r in got[:11]] == [None] * 11
    assert all(abs(r.forecast_value - (100 + 7 * (i + 12))) < 1e-3 for i, r in enumerate(got[11:]))
    assert models.trend_forecasts(df).filter(F.col("forecast_type") == "PREDICTED_GAP").count() == sum(
        100 + 7 * (i + 1) > 900 for i in range(11, 150))
