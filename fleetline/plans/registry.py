"""Every operator as a named query over the test tables.

`queries()` maps a name to a function (spark, sf_dir) -> DataFrame. Time limits are wider than the
defaults because the test tables hold one month of sparse events.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.functions import display, ids, rules
from fleetline.functions.times import epoch_seconds, from_epoch_ms, seconds_between
from fleetline.operators import agent, aggregate, asof, board, context, dedup, enrich, geometry, models
from fleetline.operators import proposals, rollup, scoring, sequence, snapshot
from fleetline.plans import jobs
from fleetline.schemas import struct
from fleetline.session import new_run_dir, staged
from fleetline.sinks import tables as sinks
from fleetline.sources import feeds, files, flatten, sample, static
from fleetline.streaming import changes
from fleetline.streaming import events as streams
from fleetline.streaming import headways as headway_streams
from fleetline.streaming import joins, runs, slices

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

DAY = 86400
FOREVER = 40 * 365 * DAY
SNAPSHOT_TTL = {"vehicles": DAY // 4, "arrivals": FOREVER, "forecasts": DAY, "surges": DAY, "weather": DAY // 4, "alerts": 2 * DAY}
MONTH_LATER = 30 * DAY


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- shared inputs ----

def _arrivals(spark, sf):
    return jobs.first_arrivals(sample.vehicle_positions(spark, sf))


def _headways(spark, sf):
    return sequence.headway(_arrivals(spark, sf))


def _stored_headways(spark, sf):
    """Headways as a written table, for operators that read them several times."""
    return staged(_headways(spark, sf), "headway")


def _alerts(spark, sf):
    return jobs.headway_alerts(_headways(spark, sf))


def _forecasts(spark, sf):
    return sequence.headway_forecast(_arrivals(spark, sf))


def _estimates(spark, sf):
    return jobs.arrival_estimates(sample.trip_updates(spark, sf), sample.AS_OF_PREDICTIONS)


def _estimates_now(spark, sf):
    """Arrival estimates moved to the end of the event month."""
    return _estimates(spark, sf).withColumn("arrival_epoch", F.col("arrival_epoch") + MONTH_LATER)


def _vehicles(spark, sf, ttl=SNAPSHOT_TTL["vehicles"]):
    return snapshot.live_vehicles(sample.vehicle_positions(spark, sf), sample.bus_positions(spark, sf),
                                  sample.AS_OF, ttl)


def _snapshot(spark, sf, stored=False):
    """All parts, lazily; `stored` writes the alerts for who reads several parts that need them."""
    alerts = staged(_alerts(spark, sf), "alerts") if stored else _alerts(spark, sf)
    tables = {
        "vehicle_positions": sample.vehicle_positions(spark, sf), "bus_positions": sample.bus_positions(spark, sf),
        "arrival_estimates": _estimates_now(spark, sf), "headway_alerts": alerts,
        "dispatcher_decisions": agent.dispatcher_decisions(alerts), "headway_forecast": _forecasts(spark, sf),
        "weather_events": sample.weather_events(spark, sf), "passenger_surges": sample.passenger_surges(spark, sf),
    }
    return snapshot.snapshot(tables, sample.AS_OF, SNAPSHOT_TTL, live_within=DAY // 24)


def _context(spark, sf):
    """The lines of the live view as a written table."""
    return staged(context.context_rows(_snapshot(spark, sf, True)), "context")


# ---- derived tables ----

@query
def latest_predictions(spark, sf):
    return jobs.latest_predictions(sample.trip_updates(spark, sf))


@query
def arrival_estimates(spark, sf):
    return _estimates(spark, sf)


@query
def first_arrivals(spark, sf):
    return _arrivals(spark, sf)


@query
def first_arrivals_by_service_date(spark, sf):
    return jobs.first_arrivals(sample.vehicle_positions(spark, sf), service_date=True)


@query
def headway(spark, sf):
    return _headways(spark, sf)


@query
def headway_alerts(spark, sf):
    return _alerts(spark, sf)


@query
def headway_triplets(spark, sf):
    return sequence.headway_triplets(_arrivals(spark, sf))


@query
def headway_forecast(spark, sf):
    return _forecasts(spark, sf)


@query
def match_consecutive_orders(spark, sf):
    """Three orders in a row of one customer, each dearer than the one before."""
    orders = sample.table(spark, sf, "orders")
    return sequence.match_consecutive(
        orders, ("o_custkey",), ("o_orderdate", "o_orderkey"), ("A", "B", "C"),
        {"B": lambda m: m["B"]("o_totalprice") > m["A"]("o_totalprice"),
         "C": lambda m: m["C"]("o_totalprice") > m["B"]("o_totalprice")},
        {"first_order": lambda m: m["A"]("o_orderkey"), "last_order": lambda m: m["C"]("o_orderkey"),
         "seconds": lambda m: seconds_between(m["A"]("o_orderdate"), m["C"]("o_orderdate"))},
        width="180 days")


@query
def corridor_congestion_hourly(spark, sf):
    return aggregate.corridor_congestion(sample.bus_positions(spark, sf), "1 hour")


@query
def corridor_congestion_minute(spark, sf):
    return aggregate.corridor_congestion(sample.bus_positions(spark, sf))


@query
def corridor_congestion_vehicles(spark, sf):
    return aggregate.corridor_congestion(sample.bus_positions(spark, sf), "1 hour", distinct_stopped=True)


@query
def corridor_congestion_rollup(spark, sf):
    """Hours and days of congestion from stored minutes with sketches; the days are made from the hours."""
    minutes = staged(rollup.congestion_rollup(sample.bus_positions(spark, sf)), "minutes")
    hours = rollup.widen_rollup(minutes, "1 hour")
    return rollup.rollup_congestion(hours).withColumn("span", F.lit("hour")).unionByName(
        rollup.rollup_congestion(rollup.widen_rollup(hours, "1 day"), distinct_stopped=True).withColumn("span", F.lit("day")))


@query
def weather_impact(spark, sf):
    return enrich.weather_impact(_alerts(spark, sf), sample.weather_events(spark, sf))


@query
def station_bottlenecks(spark, sf):
    return enrich.station_bottlenecks(_alerts(spark, sf), sample.passenger_surges(spark, sf), "1 hour")


@query
def asof_join_events(spark, sf):
    """Every purchase with the user's newest click of the last two days."""
    events = sample.table(spark, sf, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicked = events.filter("event_type = 'click'").select(
        "user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return asof.asof_join(bought, clicked, "ts", "click_ts", 2 * DAY, keys=("user_id",), ties=("click_id",),
                          width="12 hours")


@query
def dedup_alerts(spark, sf):
    return dedup.dedup_alerts(_alerts(spark, sf))


@query
def active_service_alerts(spark, sf):
    return dedup.active_service_alerts(sample.service_alerts(spark, sf))


@query
def latest_service_alerts(spark, sf):
    return dedup.latest_service_alerts(sample.service_alerts(spark, sf))


@query
def alerts_by_type(spark, sf):
    """The ad-hoc verification queries, as SQL over views of the derived tables."""
    jobs.register_views(jobs.run({"vehicle_positions": sample.vehicle_positions(spark, sf)}, sample.AS_OF))
    return spark.sql("""
        SELECT alert_type AS kind, severity AS detail, count(*) AS n FROM headway_alerts
        WHERE alert_type IN ('BUNCHING', 'GAP') GROUP BY alert_type, severity
        UNION ALL
        SELECT forecast_type, direction, count(*) FROM headway_forecast
        WHERE forecast_type <> 'STABLE' GROUP BY forecast_type, direction
        UNION ALL
        SELECT action, alert_type, count(*) FROM dispatcher_decisions GROUP BY action, alert_type""")


@query
def derived_table_counts(spark, sf):
    """Rows and latest time of all derived tables in one run."""
    built = jobs.run(
        {"trip_updates": sample.trip_updates(spark, sf), "vehicle_positions": sample.vehicle_positions(spark, sf),
         "bus_positions": sample.bus_positions(spark, sf)}, sample.AS_OF_PREDICTIONS, "1 hour")
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
             for name, df in built.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- decisions and text models ----

@query
def dispatcher_prompt(spark, sf):
    return agent.dispatcher_prompt(_alerts(spark, sf)).select("curr_trip", "prev_trip", "stop_id", "prompt")


@query
def dispatcher_decisions(spark, sf):
    return agent.dispatcher_decisions(_alerts(spark, sf))


def _echo(prompts: pd.Series) -> pd.Series:
    """A stand-in model: repeats the alert type and the headway of the prompt."""
    kind = prompts.str.extract(r"Alert Type: (\w+)", expand=False)
    seconds = prompts.str.extract(r"Observed Headway: (-?\d+)", expand=False)
    return "Action: **MONITOR**\nDispatcher Note: " + kind + "\nRider Message: " + seconds + "s\nReasoning: seen"


@query
def run_agent(spark, sf):
    asked = agent.dispatcher_prompt(_alerts(spark, sf)).select("curr_trip", "stop_id", "prompt")
    answered = agent.parse_response(agent.run_agent(asked, "prompt", _echo))
    return answered.select("curr_trip", "stop_id", "llm_action", "dispatcher_note", "rider_message", "reasoning")


@query
def run_agent_lateral(spark, sf):
    """The responder as a function in SQL."""
    agent.register_agent_function(spark, _echo, "fleet_agent")
    agent.dispatcher_prompt(_alerts(spark, sf)).createOrReplaceTempView("fleet_prompts")
    return spark.sql("SELECT curr_trip, stop_id, response FROM fleet_prompts, LATERAL (SELECT fleet_agent(prompt) AS response)")


@query
def parse_response(spark, sf):
    """Labelled and unlabelled answers made from documents; whole texts are searched."""
    docs = sample.table(spark, sf, "documents")
    case = F.col("doc_id") % 4
    text = (F.when(case == 0, F.concat(F.lit("**Action:** HOLD TRAIN \nDispatcher Note: "), "lang",
                                       F.lit("\nRider Message: to "), "source", F.lit("\nReasoning: "), F.rtrim("text")))
            .when(case == 1, F.concat(F.lit("Action:\nDispatcher Note: "), "source", F.lit("\nReasoning: "), F.rtrim("text")))
            .when(case == 2, F.rtrim("text")).otherwise(F.concat(F.lit("Rider Message: "), F.rtrim("text"))))
    parsed = agent.parse_response(docs.select("doc_id", text.alias("response")))
    return parsed.select("doc_id", "llm_action", "dispatcher_note", "rider_message", "reasoning")


@query
def decision_outbox(spark, sf):
    decisions = agent.dispatcher_decisions(_alerts(spark, sf))
    return sinks.decision_outbox(decisions.select("route_id", "direction", "stop_id", "curr_trip", "action",
                                                  "headway_seconds"))


@query
def score_decisions(spark, sf):
    return scoring.score_decisions(sample.decisions(spark, sf))


@query
def decision_mismatches(spark, sf):
    return scoring.decision_mismatches(sample.decisions(spark, sf))


@query
def expected_actions(spark, sf):
    decisions = sample.decisions(spark, sf).filter("headway_seconds IS NOT NULL")
    return decisions.select("dispatcher_note", rules.expected_action(
        F.col("alert_type"), F.col("headway_seconds")).alias("expected"))


@query
def anomaly_bounds(spark, sf):
    return models.detect_anomalies(_stored_headways(spark, sf)).select(
        "curr_trip", "stop_id", "actual_value", "lower_bound", "upper_bound", "is_anomaly")


@query
def anomaly_alerts(spark, sf):
    return models.anomaly_alerts(_stored_headways(spark, sf))


@query
def trend_forecasts(spark, sf):
    return models.trend_forecasts(_stored_headways(spark, sf)).drop("prev_headway_seconds")


@query
def route_proposals(spark, sf):
    parsed = proposals.parse_route_proposals(sample.proposals(spark, sf))
    return parsed.select(
        "doc_id", "name", "rationale", F.array_join("stops", ",").alias("stops"),
        F.when(F.col("waypoints").isNotNull(), F.size("waypoints")).otherwise(0).cast("bigint").alias("points"))


@query
def proposal_geojson(spark, sf):
    parsed = proposals.proposal_geojson(proposals.parse_route_proposals(sample.proposals(spark, sf)))
    return parsed.filter("geojson IS NOT NULL").select("doc_id", "geojson")


def _planner(prompts: pd.Series) -> pd.Series:
    """A stand-in model: a route for users' design requests, a refusal for others, else a short note."""
    route = 'Here: {"name": "Loop", "waypoints": [[40.5, -74.0], [40.75, -73.75], [99, 0]]}'
    design = prompts.str.startswith("Design a bus route")
    answers = pd.Series("noted", index=prompts.index).mask(design, "no route")
    return answers.mask(design & prompts.str.contains("from 'user'", regex=False), route)


@query
def answer_requests(spark, sf):
    text = context.context_text(_context(spark, sf))
    return agent.answer_requests(sample.requests(spark, sf), text, _planner)


@query
def copilot_prompts(spark, sf):
    text = sample.table(spark, sf, "events").agg(F.concat_ws(" ", F.count(F.lit(1)), F.lit("events")).alias("text"))
    return agent.copilot_prompt(sample.requests(spark, sf), text).select("request_id", "prompt")


# ---- the live view ----

@query
def unified_vehicles(spark, sf):
    return snapshot.unified_vehicles(sample.vehicle_positions(spark, sf), sample.bus_positions(spark, sf))


@query
def latest_state_readings(spark, sf):
    return snapshot.latest_state(sample.passenger_surges(spark, sf), ["station_id", "line"], "event_time",
                                 DAY, sample.AS_OF, ("taps_per_minute",))


@query
def soonest_per_route(spark, sf):
    return snapshot.soonest_per_route(_estimates(spark, sf).select(*snapshot.ARRIVAL_COLUMNS))


@query
def snapshot_vehicles(spark, sf):
    return snapshot.vehicles_snapshot(_vehicles(spark, sf))


@query
def snapshot_arrivals(spark, sf):
    return _snapshot(spark, sf)["arrivals"]


@query
def snapshot_alerts(spark, sf):
    return _snapshot(spark, sf)["alerts"]


@query
def snapshot_decisions(spark, sf):
    return _snapshot(spark, sf)["decisions"]


@query
def snapshot_forecasts(spark, sf):
    return _snapshot(spark, sf)["forecasts"]


@query
def snapshot_weather(spark, sf):
    return _snapshot(spark, sf)["weather"]


@query
def snapshot_surges(spark, sf):
    return _snapshot(spark, sf)["surges"]


@query
def snapshot_counts(spark, sf):
    return _snapshot(spark, sf)["counts"]


@query
def snapshot_live(spark, sf):
    return _snapshot(spark, sf)["live"]


@query
def top_routes(spark, sf):
    return aggregate.top_routes(_vehicles(spark, sf, 40 * DAY))


@query
def known_routes(spark, sf):
    return aggregate.known_routes(_vehicles(spark, sf, 40 * DAY)).orderBy("mode", "sort_key")


@query
def visible_vehicles(spark, sf):
    vehicles = snapshot.unified_vehicles(sample.vehicle_positions(spark, sf), sample.bus_positions(spark, sf))
    return enrich.mappable(enrich.filter_vehicles(vehicles, ("bus",), "r1"))


@query
def anchor_alerts(spark, sf):
    placed = enrich.anchor_alerts(_alerts(spark, sf).drop("stop_lat", "stop_lon"), _vehicles(spark, sf, 40 * DAY), "seen")
    return placed.select("curr_trip", "stop_id", "alert_type", "arrival_time", "lat", "lon")


@query
def anchor_forecasts(spark, sf):
    """Forecasts of one stop keep their coordinates, the others take those of their vehicle."""
    partly = _forecasts(spark, sf).withColumn("stop_lat", F.when(F.col("stop_id") == "S0", F.col("stop_lat")))
    placed = enrich.anchor_forecasts(partly, _vehicles(spark, sf, 40 * DAY), "seen")
    return placed.select("curr_trip", "stop_id", "forecast_type", "arrival_time", "lat", "lon")


@query
def service_alerts_by_recency(spark, sf):
    alerts = sample.service_alerts(spark, sf).withColumnRenamed("date", "ts")
    return snapshot.order_by_recency(alerts, "ts", ("alert_id",))


@query
def diverse_board_by_stop(spark, sf):
    return board.diverse_board(_estimates(spark, sf).select(*snapshot.ARRIVAL_COLUMNS), ("stop_id",))


@query
def diverse_board_global(spark, sf):
    return board.diverse_board(_estimates(spark, sf).select(*snapshot.ARRIVAL_COLUMNS))


@query
def diverse_board_route(spark, sf):
    return board.diverse_board(_estimates(spark, sf).select(*snapshot.ARRIVAL_COLUMNS), route="r3")


@query
def context_lines(spark, sf):
    return context.context_lines(_context(spark, sf))


@query
def context_text(spark, sf):
    return context.context_text(_context(spark, sf))


# ---- feeds and scalars ----

@query
def flatten_vehicles(spark, sf):
    return flatten.flatten_vehicles(sample.feed_entities(spark, sf), sample.stops(spark, sf))


@query
def flatten_trip_updates(spark, sf):
    return flatten.flatten_trip_updates(sample.feed_entities(spark, sf), sample.stops(spark, sf))


@query
def flatten_buses(spark, sf):
    return flatten.flatten_buses(sample.feed_entities(spark, sf))


@query
def flatten_buses_of_agency(spark, sf):
    return flatten.flatten_buses(sample.feed_entities(spark, sf), "east side, nowhere")


@query
def feed_stats(spark, sf):
    return aggregate.feed_stats(sample.feed_entities(spark, sf))


@query
def decode_payload(spark, sf):
    schema = struct(station_id="string", station_name="string", taps_per_minute="int")
    return files.decode_payload(sample.raw_payloads(spark, sf), schema)


@query
def merge_feeds(spark, sf):
    entities = sample.feed_entities(spark, sf).select("feed", "feed_ts")
    groups = {f"G{i}": entities.filter(F.col("feed") == f"G{i}") for i in range(8)}
    return feeds.merge_feeds(groups, "G1, G5,unknown").groupBy("feed").agg(
        F.count(F.lit(1)).alias("n"), F.max("feed_ts").alias("newest"))


@query
def tail_events(spark, sf):
    return feeds.tail_n(sample.table(spark, sf, "events"), 250, ("ts", "event_id")).select("event_id", "ts")


@query
def stop_identifiers(spark, sf):
    f = sample.feed_entities(spark, sf).filter("vehicle IS NOT NULL")
    stop, trip = F.col("vehicle.stop_id"), F.col("vehicle.trip.trip_id")
    return f.groupBy(stop.alias("stop_id"), ids.base_id(stop).alias("base"),
                     ids.direction(stop, trip).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query
def route_identifiers(spark, sf):
    f = sample.feed_entities(spark, sf).filter("vehicle IS NOT NULL")
    route, vehicle = F.col("vehicle.trip.route_id"), F.col("vehicle.vehicle_id")
    return f.groupBy(ids.route_short(route).alias("route_short"), ids.agency_of(vehicle).alias("agency"),
                     ids.agency_selected(vehicle, "West").alias("is_west")).agg(F.count(F.lit(1)).alias("n"))


@query
def rule_columns(spark, sf):
    """All rule and label expressions over the events, counted."""
    e = sample._numbered_events(spark, sf)
    k, seconds = F.col("k"), F.floor(F.col("value") * 8).cast("bigint")
    kind = rules.alert_type(seconds)
    return e.groupBy(
        kind.alias("kind"), rules.alert_severity(seconds).alias("severity"),
        rules.dispatcher_action(kind, seconds).alias("action"),
        rules.forecast_type(seconds, k * 10).alias("forecast"),
        rules.weather_condition(k).alias("condition"),
        rules.weather_risk(F.when(k % 3 != 0, k / 50), F.when(k % 4 != 0, k / 2)).alias("risk"),
        rules.status_name(k % 5).alias("status"),
        display.direction_label(F.when(k % 4 == 0, "N").when(k % 4 == 1, "0").when(k % 4 == 2, "E")).alias("label"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def eta_texts(spark, sf):
    return _estimates(spark, sf).filter("eta_seconds >= 0").select(
        "trip_id", "stop_id", display.eta_text(F.col("eta_seconds")).alias("eta_text"),
        display.direction_label(F.col("direction")).alias("heading"))


@query
def arrival_keys(spark, sf):
    e = sample._numbered_events(spark, sf)
    k = F.col("k")
    rows = e.select(
        "event_id", F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("T"), "user_id")).alias("trip_id"),
        F.when(k % 2 == 0, F.concat(F.lit("C"), "user_id")).alias("curr_trip"), F.lit("R1").alias("route_id"),
        F.when(k % 4 == 0, "N").alias("direction"),
        F.when(k % 5 != 0, F.concat(F.lit("S"), k)).alias("stop_id"),
        F.when(k % 7 != 0, F.concat(F.lit("Stop "), k)).alias("stop_name"))
    return ids.arrival_keys(rows)


@query
def eta_at(spark, sf):
    """Etas read later than written, half of them without an absolute arrival time."""
    rows = _estimates(spark, sf).withColumn(
        "event_time", F.lit("2023-12-31 23:58:20").cast("timestamp_ntz")).withColumn(
        "arrival_epoch", F.when(F.col("eta_seconds") % 2 == 0, F.col("arrival_epoch")).otherwise(0))
    return snapshot.eta_at(rows, sample.AS_OF_PREDICTIONS + 100).select("trip_id", "stop_id", "eta_seconds")


@query
def normalize_surges(spark, sf):
    raw = sample.passenger_surges(spark, sf)
    taps = F.col("taps_per_minute")
    blanked = raw.select(
        F.when(taps % 3 == 0, "").otherwise(F.col("station_id")).alias("station_id"),
        F.when(taps % 7 != 0, F.col("station_name")).alias("station_name"), "line",
        F.when(taps % 5 != 0, taps).alias("taps_per_minute"),
        F.when(taps % 4 != 0, F.lower("crowd_level")).alias("crowd_level"), "event_time")
    return snapshot.normalize_surges(blanked)


@query
def normalize_weather(spark, sf):
    return snapshot.normalize_weather(sample.weather_events(spark, sf), ("event_id",))


@query
def epoch_times(spark, sf):
    surges = sample.passenger_surges(spark, sf)
    at = from_epoch_ms(F.col("event_time"))
    return surges.select("event_time", at.alias("seen"), epoch_seconds(at).alias("seconds"))


# ---- static geometry ----

@query
def trunk_shapes(spark, sf):
    return geometry.trunk_shapes(sample.shapes(spark, sf), sample.trips(spark, sf))


@query
def route_shapes(spark, sf):
    return geometry.route_shapes(sample.shapes(spark, sf), sample.trips(spark, sf), sample.routes(spark, sf))


@query
def geojson_features(spark, sf):
    """Route lines written as GeoJSON and read back."""
    lines = geometry.route_shapes(sample.shapes(spark, sf), sample.trips(spark, sf), sample.routes(spark, sf))
    path = new_run_dir(spark, "shapes")
    sinks.write_features(geometry.to_geojson_features(lines, "bus"), path)
    back = files.read_shapes(spark, path)
    first, last = F.element_at("coordinates", 1), F.element_at("coordinates", -1)
    return back.select("route_id", "mode", "color", "part", "n_points", first[0].alias("first_lon"),
                       first[1].alias("first_lat"), last[0].alias("last_lon"), last[1].alias("last_lat"))


@query
def static_files(spark, sf):
    """Stops, shapes, trips and routes through CSV files."""
    path = new_run_dir(spark, "static")
    messy = sample.stops(spark, sf).select(
        F.concat(F.lit(" "), "stop_id", F.lit(" ")).alias("stop_id"), "stop_name",
        F.when(F.col("stop_id") == "S3", F.lit("north")).otherwise(F.col("stop_lat").cast("string")).alias("stop_lat"),
        F.col("stop_lon").cast("string").alias("stop_lon"))
    messy.write.csv(f"{path}/stops.txt", header=True)
    sample.shapes(spark, sf).write.csv(f"{path}/shapes.txt", header=True)
    sample.trips(spark, sf).select("shape_id", "route_id").write.csv(f"{path}/trips.txt", header=True)
    sample.routes(spark, sf).write.csv(f"{path}/routes.txt", header=True)
    parts = static.read_gtfs_static(spark, path)
    stops = static.read_stops(spark, f"{path}/stops.txt")
    none = F.lit(None).cast("double")
    out = stops.select(F.lit("stops").alias("name"), F.col("stop_id").alias("id"), F.col("stop_name").alias("detail"),
                       F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    for name, row in (("shapes", ("shape_id", F.col("shape_pt_sequence").cast("string"), "shape_pt_lat", "shape_pt_lon")),
                      ("trips", ("shape_id", "route_id", none, none)), ("routes", ("route_id", "route_color", none, none))):
        out = out.union(parts[name].select(F.lit(name), *row))
    return out


# ---- sources and sinks over files ----

@query
def read_service_alerts(spark, sf):
    path = new_run_dir(spark, "landing")
    sample.service_alerts(spark, sf).write.json(path)
    return dedup.latest_service_alerts(feeds.read_service_alerts(spark, path))


@query
def read_weather_events(spark, sf):
    path = new_run_dir(spark, "landing")
    sample.weather_events(spark, sf).select("current").write.json(path)
    return feeds.read_weather_events(spark, path).select("event_time", *[f"current.{c}" for c in (
        "temperature_2m", "precipitation", "rain", "weather_code", "wind_speed_10m")])


@query
def read_feeds(spark, sf):
    """Positions, predictions, buses and surges through Parquet files."""
    path = new_run_dir(spark, "landing")
    tables = {"vehicle_positions": feeds.read_vehicle_positions, "trip_updates": feeds.read_trip_updates,
              "bus_positions": feeds.read_bus_positions, "passenger_surges": feeds.read_passenger_surges}
    out = None
    for name, reader in tables.items():
        getattr(sample, name)(spark, sf).write.parquet(f"{path}/{name}")
        part = reader(spark, f"{path}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def _landed(spark, rows, reader):
    """A feed written as files and read back, with the columns written."""
    path = new_run_dir(spark, "landing")
    rows.write.parquet(path)
    return reader(spark, path).select(*rows.columns)


@query
def read_vehicle_positions(spark, sf):
    return _landed(spark, sample.vehicle_positions(spark, sf), feeds.read_vehicle_positions)


@query
def read_trip_updates(spark, sf):
    return _landed(spark, sample.trip_updates(spark, sf), feeds.read_trip_updates)


@query
def read_bus_positions(spark, sf):
    return _landed(spark, sample.bus_positions(spark, sf), feeds.read_bus_positions)


@query
def read_passenger_surges(spark, sf):
    return _landed(spark, sample.passenger_surges(spark, sf), feeds.read_passenger_surges)


@query
def read_decisions_jsonl(spark, sf):
    """Logged decisions with broken and blank lines in between."""
    path = new_run_dir(spark, "landing")
    rows = sample.decisions(spark, sf)
    line = F.to_json(F.struct(*rows.columns))
    number = F.regexp_extract("dispatcher_note", r"(\d+)", 1).cast("int")
    rows.select(F.when(number % 11 == 0, F.concat(F.lit("{"), line)).when(number % 11 == 1, "").otherwise(line)
                .alias("value")).write.text(path)
    return scoring.score_decisions(files.read_decisions_jsonl(spark, path))


@query
def outbox_file(spark, sf):
    path = new_run_dir(spark, "outbox")
    decisions = agent.dispatcher_decisions(_alerts(spark, sf))
    sinks.write_outbox(decisions, path)
    return files.read_decisions_jsonl(spark, path)


@query
def bucketed_estimates(spark, sf):
    path = new_run_dir(spark, "buckets")
    sinks.write_bucketed(_estimates(spark, sf), path, ("trip_id", "stop_id"))
    return spark.read.parquet(path).drop("bucket")


@query
def keyed_table(spark, sf):
    """Predictions in three changes, the first two compacted; the newest per key remains."""
    path = new_run_dir(spark, "keyed")
    rows = sample.trip_updates(spark, sf).filter("arrival_epoch > 0").select(*jobs.STOP_COLUMNS, "arrival_epoch", "event_time")
    keys = ("trip_id", "stop_id")
    for change in range(3):
        part = rows.filter(F.pmod("arrival_epoch", F.lit(3)) == change)
        sinks.write_changes(part, path, change, keys, "event_time", ("arrival_epoch",))
        if change == 1:
            sinks.compact(spark, path, rows.schema, keys, "event_time", ("arrival_epoch",))
    return sinks.read_keyed(spark, path, rows.schema, keys, "event_time", ("arrival_epoch",))


# ---- streams, closed after the end of the data ----

# A month later, and far enough apart not to meet in a join.
CLOSING, CLOSING_ALERTS = "2024-03-20 00:00:00", "2024-03-10 00:00:00"
CLOSING_MS = 1710892800000
#: Moments at which the state of a stream is read.
STATE_MS = (1706572800000, 1706659200000)
#: Between the two runs of the chained streams.
CHAIN_STOP = "2024-01-16 00:00:00"


def _streamed_headways(spark, sf):
    """Folder of the tables that the stream of positions makes."""
    base = new_run_dir(spark, "headways")
    positions = runs.closed(sample.vehicle_positions(spark, sf, True), event_time=CLOSING)
    # The test tables hold each trip once, a month long.
    runs.finish(headway_streams.headway_stream(positions, f"{base}/data", f"{base}/checkpoint", horizon="40 days", width="10 days"))
    return f"{base}/data"


@query
def stream_congestion(spark, sf):
    buses = streams.with_feed_watermark(runs.closed(sample.bus_positions(spark, sf, True), event_time=CLOSING, route_short="-"))
    return runs.run_append(streams.corridor_congestion_stream(buses, "1 hour"))


@query
def stream_headway(spark, sf):
    return headway_streams.read_headways(spark, _streamed_headways(spark, sf))


@query
def stream_forecast(spark, sf):
    return headway_streams.read_forecasts(spark, _streamed_headways(spark, sf))


@query
def stream_first_rows(spark, sf):
    base = new_run_dir(spark, "first")
    positions = runs.closed(sample.vehicle_positions(spark, sf, True), event_time=CLOSING, current_status="STOPPED_AT")
    stopped = positions.filter("current_status = 'STOPPED_AT'").select(*jobs.STOP_COLUMNS, "event_time")
    runs.finish(joins.first_rows_stream(stopped, ("trip_id", "stop_id"), "event_time", f"{base}/data", f"{base}/checkpoint",
                                        ("route_id", "direction", "stop_name"), width="10 days"))
    return slices.read_closed(spark, f"{base}/data/first", stopped.schema)


@query
def stream_latest_state(spark, sf):
    """Crowd readings that are valid at two moments: the end of the data, and a day and a half later, when few are."""
    out, schema = None, sample.passenger_surges(spark, sf).schema
    keys, at, delay = ["station_id", "line"], F.col("event_time") * 1000, "30 seconds"
    base = new_run_dir(spark, "state")
    readings = sample.passenger_surges(spark, sf, True).filter(F.col("event_time") <= STATE_MS[0])
    for moment in STATE_MS:
        # The stream goes on with one more row, which moves the mark to the moment.
        runs.write_last(spark, schema, f"{base}/clock/{moment}", event_time=moment + 30_000)
        clock = spark.readStream.schema(schema).parquet(f"{base}/clock/*")
        stream = readings.unionByName(clock)
        runs.finish(joins.latest_state_stream(stream, at, keys, "event_time", DAY * 3 // 2, f"{base}/data", f"{base}/checkpoint",
                                              ("taps_per_minute",), delay, "10 days"))
        valid = joins.read_latest_state(spark, f"{base}/data", schema, keys).withColumn("moment", F.lit(moment))
        valid = staged(valid.filter("station_id IS NOT NULL"), "valid")  # without the rows that moved the mark
        out = valid if out is None else out.unionByName(valid)
    return out


@query
def stream_latest_rows(spark, sf):
    rows = sample.trip_updates(spark, sf, True).filter("arrival_epoch > 0")
    rows = rows.select("trip_id", "stop_id", "arrival_epoch", F.col("event_time").cast("timestamp").alias("event_time"))
    newest = streams.dedup_last_stream(rows, ("trip_id", "stop_id"), "event_time")
    latest = runs.run_upsert(newest, ("trip_id", "stop_id"), "event_time", ties=("arrival_epoch",), output_mode="update")
    return latest.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query
def stream_upsert(spark, sf):
    """The same result without streaming state: the keyed table resolves the newest row when read."""
    rows = sample.trip_updates(spark, sf, True).filter("arrival_epoch > 0").select(
        "trip_id", "stop_id", "arrival_epoch", "event_time")
    return runs.run_upsert(rows, ("trip_id", "stop_id"), "event_time", ties=("arrival_epoch",))


@query
def stream_arrival_estimates(spark, sf):
    base = new_run_dir(spark, "predictions")
    updates = sample.trip_updates(spark, sf, True)
    runs.finish(runs.predictions_stream(updates, f"{base}/data", f"{base}/checkpoint"))
    return runs.read_arrival_estimates(spark, f"{base}/data", sample.AS_OF_PREDICTIONS)


def _stored_alerts(spark, sf):
    alerts = staged(_alerts(spark, sf), "alerts")
    return spark.readStream.schema(alerts.schema).parquet(alerts.inputFiles()[0].rsplit("/", 1)[0])


def _closed_alerts(spark, sf):
    return runs.closed(_stored_alerts(spark, sf), arrival_time=CLOSING_ALERTS)


def _alert_stream(spark, sf):
    return streams.with_alert_watermark(_stored_alerts(spark, sf))


@query
def stream_weather_impact(spark, sf):
    base = new_run_dir(spark, "weather")
    weather = runs.closed(sample.weather_events(spark, sf, True), event_time=CLOSING)
    runs.finish(joins.weather_impact_stream(_closed_alerts(spark, sf), weather, f"{base}/data", f"{base}/checkpoint", width="10 days"))
    return slices.read_closed(spark, f"{base}/data/joined", weather_impact(spark, sf).schema)


@query
def stream_bottlenecks(spark, sf):
    base = new_run_dir(spark, "bottlenecks")
    surges = runs.closed(sample.passenger_surges(spark, sf, True), event_time=CLOSING_MS)
    runs.finish(joins.station_bottlenecks_stream(_closed_alerts(spark, sf), surges, f"{base}/data", f"{base}/checkpoint", "1 hour", width="10 days"))
    return slices.read_closed(spark, f"{base}/data/joined", station_bottlenecks(spark, sf).schema)


def _in_two_runs(spark, rows, ts, run, **last):
    """Lets a stream run over the rows before the middle of the month, and again over the others and a row that closes it."""
    base = new_run_dir(spark, "halves")
    early = F.col(ts) < F.lit(CHAIN_STOP).cast(rows.schema[ts].dataType)
    for part, half in enumerate((early, ~early)):
        rows.filter(half).write.parquet(f"{base}/in/{part}")
        if part:
            runs.write_last(spark, rows.schema, f"{base}/in/end", **{ts: CLOSING, **last})
        runs.finish(run(spark.readStream.schema(rows.schema).parquet(f"{base}/in/*"), f"{base}/data", f"{base}/checkpoint"))
    return f"{base}/data"


@query
def stream_vehicle_counts(spark, sf):
    """Vehicles by route and status of their newest ping, kept from a log of changes; each ping is a correction of the one before."""
    keys, rows = ("trip_id",), sample.bus_positions(spark, sf).select("trip_id", "route_short", "current_status", "bearing", "event_time")
    path = _in_two_runs(spark, rows, "event_time", lambda stream, data, checkpoint: changes.change_log_stream(
        stream, keys, "event_time", data, checkpoint, ("route_short", "current_status", "bearing"), horizon="40 days", width="10 days"))
    log = changes.read_change_log(spark, path, rows.schema, keys)
    return changes.sums_of_log(log, keys, ("route_short", "current_status"), count="vehicles")


@query
def stream_rollup(spark, sf):
    """Hours of congestion from the sketches that a stream of buses left."""
    rows = sample.bus_positions(spark, sf)
    path = _in_two_runs(spark, rows, "event_time", lambda stream, data, checkpoint: changes.congestion_rollup_stream(
        stream, data, checkpoint, width="10 days"))
    return rollup.rollup_congestion(rollup.widen_rollup(changes.read_rollup(spark, path, rows.schema), "1 hour"))


def _streamed_models(spark, sf):
    """Folder of the tables that the stream of headways makes."""
    return _in_two_runs(spark, _stored_headways(spark, sf), "arrival_time", lambda stream, data, checkpoint: changes.model_stream(
        stream, data, checkpoint, width="10 days"))


@query
def stream_anomalies(spark, sf):
    return changes.read_anomalies(spark, _streamed_models(spark, sf))


@query
def stream_trends(spark, sf):
    return changes.read_trends(spark, _streamed_models(spark, sf)).drop("prev_headway_seconds")


@query
def stream_pipeline(spark, sf):
    """Positions to headways, alerts, decisions and alerts with weather: four streams, each reading the table of the one before.

    The first runs twice, stopped in between with half the data, so the others go on with what it added.
    """
    base = new_run_dir(spark, "chain")
    positions = sample.vehicle_positions(spark, sf)
    halves = [F.col("event_time") < F.lit(CHAIN_STOP).cast("timestamp_ntz"), F.col("event_time") >= F.lit(CHAIN_STOP).cast("timestamp_ntz")]
    weather = runs.closed(sample.weather_events(spark, sf, True), event_time=CLOSING)
    headways = spark.readStream.schema(headway_streams.HEADWAYS).option("recursiveFileLookup", "true")
    for part, half in enumerate(halves):
        positions.filter(half).write.parquet(f"{base}/in/{part}")
        if part:
            runs.write_last(spark, positions.schema, f"{base}/in/end", event_time=CLOSING)
            runs.write_last(spark, headway_streams.HEADWAYS, f"{base}/headways/headways/change=closing", arrival_time=CLOSING_ALERTS, headway_seconds=0)
        stream = spark.readStream.schema(positions.schema).parquet(f"{base}/in/*")
        runs.finish(headway_streams.headway_stream(stream, f"{base}/headways", f"{base}/ck_headways", horizon="40 days", width="10 days"))
        alerts = jobs.headway_alerts(headways.parquet(f"{base}/headways/headways"))
        runs.finish(joins.weather_impact_stream(alerts, weather, f"{base}/weather", f"{base}/ck_weather", width="10 days"))
        decided = streams.with_alert_watermark(alerts.filter("curr_trip IS NOT NULL"))
        runs.finish(runs.dispatcher_stream(decided, f"{base}/decisions", f"{base}/ck_decisions", _echo))
    enriched = slices.read_closed(spark, f"{base}/weather/joined", weather_impact(spark, sf).schema)
    decisions = spark.read.parquet(f"{base}/decisions")
    columns = ["route_id", "direction", "stop_name", "alert_type", "severity", "headway_seconds"]
    return enriched.select(F.lit("weather").alias("part"), *columns, F.col("weather_risk_level").alias("result")).unionByName(
        decisions.select(F.lit("decision").alias("part"), *columns, F.col("action").alias("result")))


@query
def stream_outbox(spark, sf):
    """Decisions delivered as the stream makes them, read back as the receiver gets them."""
    base = new_run_dir(spark, "outbox")
    runs.finish(runs.dispatcher_stream(_alert_stream(spark, sf), f"{base}/data", f"{base}/checkpoint", _echo, outbox=f"{base}/out"))
    return files.read_decisions_jsonl(spark, f"{base}/out").drop("change")


@query
def stream_decisions(spark, sf):
    base = new_run_dir(spark, "decisions")
    runs.finish(runs.dispatcher_stream(_alert_stream(spark, sf), f"{base}/data", f"{base}/checkpoint", _echo))
    alerts = _alerts(spark, sf)
    schema = agent.dispatcher_decisions(alerts.withColumn("arrival_time", F.col("arrival_time").cast("timestamp"))).schema
    found = sinks.read_keyed(spark, f"{base}/data", schema, dedup.ALERT_IDENTITY)
    return found.withColumn("arrival_time", F.col("arrival_time").cast("timestamp_ntz"))
