"""What the plans must and must not contain."""

import pytest

from fleetline.plans import jobs, registry
from fleetline.sources import sample


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# A stream has run when its query returns, and the plan left is that of reading its files.
@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if not n.startswith("stream_")))
def test_no_pairing_of_everything(spark, sf_dir, name):
    text = plan(registry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_stored_and_lazy_runs_agree(spark, sf_dir):
    tables = {"vehicle_positions": sample.vehicle_positions(spark, sf_dir), "trip_updates": sample.trip_updates(spark, sf_dir),
              "bus_positions": sample.bus_positions(spark, sf_dir), "weather_events": sample.weather_events(spark, sf_dir),
              "passenger_surges": sample.passenger_surges(spark, sf_dir)}
    lazy = jobs.run(tables, sample.AS_OF_PREDICTIONS)
    stored = jobs.run(tables, sample.AS_OF_PREDICTIONS, stage=True)
    assert set(lazy) == set(stored) and len(lazy) == 8
    for name in lazy:
        assert sorted(map(str, lazy[name].collect())) == sorted(map(str, stored[name].collect())), name


def test_first_rows_are_limited_before_the_shuffle(spark, sf_dir):
    text = plan(registry.queries()["first_arrivals"](spark, sf_dir))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange hashpartitioning") == 1


def test_arrivals_are_shuffled_once_for_headways(spark, sf_dir):
    df = registry.queries()["headway"](spark, sf_dir)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_headways_shuffle_by_time_slice(spark, sf_dir):
    text = plan(registry.queries()["headway"](spark, sf_dir))
    last = text[text.index("Exchange hashpartitioning"):].split("\n")[0]
    assert "_slice" in last


def test_board_meets_in_few_exchanges_without_python(spark, sf_dir):
    text = plan(registry.queries()["diverse_board_by_stop"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") <= 3 and "Pandas" not in text and "Python" not in text


def test_context_meets_in_one_shuffle(spark, sf_dir):
    df = registry.queries()["context_text"](spark, sf_dir)
    # One by section, one for the text, and one for the flag of the first line.
    assert plan(df).count("Exchange ") <= 3


def test_long_look_backs_shuffle_by_slice_without_a_count_or_join(spark, sf_dir):
    text = plan(registry.queries()["anomaly_bounds"](spark, sf_dir))
    last = text[text.index("Exchange hashpartitioning"):].split("\n")[0]
    assert "_slice" in last and "Join" not in text


def test_keyless_asof_join_is_salted(spark, sf_dir):
    text = plan(registry.queries()["weather_impact"](spark, sf_dir))
    assert any("_slice" in line and "_salt" in line for line in text.split("\n") if "Exchange hashpartitioning" in line)


def test_the_model_is_called_in_batches(spark, sf_dir):
    text = plan(registry.queries()["run_agent_lateral"](spark, sf_dir))
    assert "ArrowEvalPython" in text and "BatchEvalPython" not in text


def test_snapshot_age_reaches_the_scan(spark, sf_dir):
    text = plan(registry._vehicles(spark, sf_dir, 3600))
    scans = [line for line in text.split("\n") if "FileScan" in line]
    assert scans and all("GreaterThanOrEqual(ts" in line for line in scans)


def test_scans_read_only_needed_columns(spark, sf_dir):
    text = plan(registry.queries()["corridor_congestion_hourly"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text
    assert sample.table(spark, sf_dir, "events").count() > 0
