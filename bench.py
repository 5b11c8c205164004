"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then three times; the median counts. Results go to the `noop` sink,
so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from fleetline.plans.registry import queries
from fleetline.session import build_session

HEADLINE = (
    "arrival_estimates", "first_arrivals", "headway", "headway_alerts", "headway_forecast",
    "corridor_congestion_hourly", "weather_impact", "station_bottlenecks", "dispatcher_decisions",
    "anomaly_alerts", "trend_forecasts", "flatten_vehicles", "flatten_trip_updates", "snapshot_vehicles",
    "soonest_per_route", "diverse_board_by_stop", "route_shapes", "score_decisions",
    "asof_join_events", "context_text", "stream_headway", "stream_decisions",
)
RUNS = 3


def write(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    seconds, exchanges = {}, {}
    for name in HEADLINE:
        write(known[name](spark, sf_dir))
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            df = known[name](spark, sf_dir)
            write(df)
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges[name] = plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "exchanges": exchanges, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
