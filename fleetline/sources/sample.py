"""Views of the generic test tables in the fleet schemas.

Each function is a stateless projection (or a small aggregate) of a table in `sf_dir`, so every query
built on it grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.functions.times import epoch_seconds

AS_OF_PREDICTIONS = 1704067200
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if not stream:
        return spark.read.parquet(path)
    either = f"{sf_dir}/{name}.parque[t]"  # a pattern, since a file stream takes no single file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(either)


def _numbered_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    number = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return table(spark, sf_dir, "events", stream).withColumn("k", number)


def _trip():
    return F.concat(F.lit("T"), F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyyMMdd"))


def _status():
    return (F.when(F.col("event_type") == "click", "INCOMING_AT")
            .when(F.col("event_type") == "error", "IN_TRANSIT_TO").otherwise("STOPPED_AT"))


def vehicle_positions(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    side = F.col("k") % 2
    return _numbered_events(spark, sf_dir, stream).select(
        _trip().alias("trip_id"),
        F.concat(F.lit("R"), (F.col("user_id") % 2).cast("string")).alias("route_id"),
        F.when(F.expr("(user_id div 2) % 2 = 0"), "N").otherwise("S").alias("direction"),
        F.concat(F.lit("S"), side.cast("string")).alias("stop_id"),
        F.concat(F.lit("S"), side.cast("string")).alias("stop_base"),
        F.concat(F.lit("Stop "), side.cast("string")).alias("stop_name"),
        (F.lit(40.5) + side * F.lit(0.25)).alias("stop_lat"),
        (F.lit(-74.0) + side * F.lit(0.125)).alias("stop_lon"),
        _status().alias("current_status"),
        side.cast("int").alias("stop_sequence"),
        F.col("ts").alias("event_time"),
    )


def bus_positions(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    return table(spark, sf_dir, "events", stream).select(
        _trip().alias("trip_id"),
        F.concat(F.lit("CITY_R"), (F.col("user_id") % 2).cast("string")).alias("route_id"),
        F.concat(F.lit("R"), (F.col("user_id") % 2).cast("string")).alias("route_short"),
        F.when(F.col("user_id") % 3 == 0, "0").otherwise("1").alias("direction"),
        F.lit("").alias("stop_id"),
        (F.lit(40.5) + (F.col("user_id") % 64) / 128).alias("vehicle_lat"),
        (F.lit(-74.0) + (F.col("user_id") % 32) / 64).alias("vehicle_lon"),
        F.when(F.col("user_id") % 5 == 0, F.lit(None).cast("double")).otherwise((F.col("user_id") % 360).cast("double")).alias("bearing"),
        _status().alias("current_status"),
        F.col("ts").alias("event_time"))


def trip_updates(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    stop = F.col("l_suppkey") % 40
    arrival = F.lit(AS_OF_PREDICTIONS) + F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131, F.lit(4000)) - 1000
    return table(spark, sf_dir, "lineitem", stream).select(
        F.concat(F.lit("T"), (F.col("l_orderkey") % 3000).cast("string")).alias("trip_id"),
        F.concat(F.lit("R"), (F.col("l_orderkey") % 12).cast("string")).alias("route_id"),
        F.when(F.col("l_orderkey") % 2 == 0, "N").otherwise("S").alias("direction"),
        F.concat(F.lit("S"), stop.cast("string")).alias("stop_id"),
        F.concat(F.lit("S"), stop.cast("string")).alias("stop_base"),
        F.concat(F.lit("Stop "), stop.cast("string")).alias("stop_name"),
        (F.lit(40.5) + stop / 64).alias("stop_lat"), (F.lit(-74.0) + stop / 128).alias("stop_lon"),
        F.when(F.col("l_linenumber") == 7, F.lit(0).cast("bigint")).otherwise(arrival).alias("arrival_epoch"),
        (arrival + 20).alias("departure_epoch"),
        (F.col("l_shipdate") + F.make_dt_interval(secs=F.col("l_linenumber"))).alias("event_time"))


def weather_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Every `view` event as an observation."""
    k, whole = F.col("k"), F.floor("value").cast("double")
    current = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), F.lit(900).alias("interval"),
        F.when(k % 10 != 9, whole / 2 - 20).alias("temperature_2m"), (k % 100).alias("relative_humidity_2m"),
        F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 0.4).when(k % 4 == 2, 1.5).alias("precipitation"),
        F.when(k % 8 < 4, 0.0).otherwise(2.5).alias("rain"),
        F.when(k % 7 != 6, k).alias("weather_code"),
        F.when(k % 5 != 0, F.pmod(whole, F.lit(40.0))).alias("wind_speed_10m"))
    return _numbered_events(spark, sf_dir, stream).filter("event_type = 'view'").select(
        current.alias("current"), F.col("ts").alias("event_time"), "event_id")


def passenger_surges(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Every `signup` event as a turnstile reading; `event_time` is epoch milliseconds."""
    station = (F.col("user_id") % 5).cast("string")
    level = F.element_at(F.array(*[F.lit(x) for x in ("NORMAL", "MODERATE", "HIGH", "SURGE")]),
                         (F.col("k") % 4 + 1).cast("int"))
    return _numbered_events(spark, sf_dir, stream).filter("event_type = 'signup'").select(
        F.concat(F.lit("ST"), station).alias("station_id"), F.concat(F.lit("Station "), station).alias("station_name"),
        F.concat(F.lit("LR"), (F.col("user_id") % 2).cast("string")).alias("line"),
        (F.lit(200) + F.col("k") * 20).cast("int").alias("taps_per_minute"), level.alias("crowd_level"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time"))


def service_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("A"), text).alias("alert_id"), F.concat(F.lit("E"), F.col("o_custkey").cast("string")).alias("event_id"),
        (F.col("o_orderkey") % 7).cast("string").alias("update_number"),
        F.concat(F.lit("AG"), (F.col("o_custkey") % 3).cast("string")).alias("agency"),
        F.col("o_orderpriority").alias("affected"),
        F.when(F.col("o_orderstatus") == "F", "delays").when(F.col("o_orderstatus") == "O", "").alias("status_label"),
        F.concat(F.lit("Notice "), text).alias("header"), F.concat(F.lit("Details of notice "), text).alias("description"),
        (epoch_seconds("o_orderdate") * 1000).alias("date"))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as stops; every fifth also has an entry with a direction letter."""
    number = F.col("n_nationkey")
    base = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("S"), number.cast("string")).alias("stop_id"), F.col("n_name").alias("stop_name"),
        (F.lit(40.0) + number / 32).alias("stop_lat"), (F.lit(-74.0) + number / 64).alias("stop_lon"), number.alias("n"))
    lettered = base.filter("n % 5 = 0").withColumn("stop_id", F.concat("stop_id", F.lit("N"))).withColumn(
        "stop_name", F.concat("stop_name", F.lit(" North")))
    return base.unionByName(lettered).drop("n")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("SH"), (F.col("l_suppkey") % 50).cast("string")).alias("shape_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int").alias("shape_pt_sequence"),
        (F.lit(40.0) + F.col("l_partkey") / 65536).alias("shape_pt_lat"),
        (F.lit(-74.0) + F.col("l_quantity") / 64).alias("shape_pt_lon"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("SH"), (F.col("o_orderkey") % 60).cast("string")).alias("shape_id"),
        F.concat(F.lit("R"), (F.col("o_custkey") % 20).cast("string")).alias("route_id"),
        F.col("o_orderkey").alias("trip_order"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("route_id"),
        F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(
            F.lpad(F.hex(F.col("n_nationkey") * 4099), 6, "0")).alias("route_color"))


def feed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested feed entities: sign-ups and purchases are trip updates, the rest vehicles."""
    k, user = F.col("k"), F.col("user_id")
    stop = F.concat(F.lit("S"), (k % 40).cast("string"),
                    F.when(k % 3 == 0, "N").when(k % 3 == 1, "S").otherwise(""))
    seconds = epoch_seconds("ts")
    trip = F.struct(
        F.when(k % 10 == 0, "").otherwise(_trip()).alias("trip_id"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("LOCAL_R"), (user % 20).cast("string"))).alias("route_id"),
        F.when(k % 4 != 0, (k % 2).cast("int")).alias("direction_id"))
    position = F.when(k % 7 != 0, F.struct(
        F.when(k % 11 == 0, 0.0).otherwise(F.lit(40.0) + user / 1024).alias("latitude"),
        (F.lit(-74.0) + user / 2048).alias("longitude"),
        F.when(k % 3 != 0, (user % 360).cast("double")).alias("bearing")))
    vehicle = F.struct(
        trip.alias("trip"),
        F.concat(F.when(user % 3 == 0, "EAST SIDE_").when(user % 3 == 1, "WEST_").otherwise(""),
                 user.cast("string")).alias("vehicle_id"),
        stop.alias("stop_id"), (k % 4).cast("int").alias("current_status"),
        k.cast("int").alias("current_stop_sequence"),
        F.when(k % 5 == 0, F.lit(0).cast("bigint")).otherwise(seconds - 7).alias("timestamp"),
        position.alias("position"))

    def call(offset: int):
        return F.struct(
            F.when((k + offset) % 9 == 0, "").otherwise(F.concat(F.lit("S"), ((k + offset) % 40).cast("string"))).alias("stop_id"),
            F.when((k + offset) % 6 == 0, F.lit(0).cast("bigint")).otherwise(seconds + 60 * (offset + 1)).alias("arrival"),
            F.when((k + offset) % 4 != 0, seconds + 60 * (offset + 1) + 20).alias("departure"))

    update = F.struct(trip.alias("trip"), F.array(call(0), call(1), call(2)).alias("stop_time_update"))
    is_update = F.col("event_type").isin("signup", "purchase")
    return _numbered_events(spark, sf_dir).select(
        F.concat(F.lit("G"), (user % 8).cast("string")).alias("feed"), seconds.alias("feed_ts"),
        F.when(~is_update, vehicle).alias("vehicle"), F.when(is_update, update).alias("trip_update"))


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as broker records: a third framed, some broken, keys with an own station id on some."""
    k = F.col("k")
    text = F.to_json(F.struct(F.concat(F.lit("ST"), F.col("user_id").cast("string")).alias("station_id"),
                              F.col("event_type").alias("station_name"), k.alias("taps_per_minute")))
    text = F.when(k % 17 == 0, F.concat(F.lit("{broken "), text)).otherwise(text)
    value = F.when(k % 3 == 0, F.concat(F.unhex(F.lit("0000000001")), text.cast("binary"))).otherwise(text.cast("binary"))
    key = F.when(k % 5 == 0, F.to_json(F.struct(F.concat(F.lit("KEY"), k.cast("string")).alias("station_id")))).cast("binary")
    return _numbered_events(spark, sf_dir).select("event_id", value.alias("value"), key.alias("key"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged decisions, some wrong, some incomplete."""
    k, user = F.col("k"), F.col("user_id")
    kind = F.when(k % 4 == 0, "BUNCHING").when(k % 4 == 1, " gap ").when(k % 4 == 2, "OTHER")

    def said(n):
        return (F.when(n == 0, "HOLD TRAIN").when(n == 1, "gap fill").when(n == 2, "MONITOR").when(n == 3, ""))

    return _numbered_events(spark, sf_dir).select(
        F.concat(F.lit("R"), (user % 20).cast("string")).alias("route_id"), F.lit("N").alias("direction"),
        F.concat(F.lit("S"), (k % 40).cast("string")).alias("stop_id"), F.lit("Stop").alias("stop_name"),
        kind.alias("alert_type"), F.lit("MEDIUM").alias("severity"),
        F.when(k % 9 != 0, F.floor(F.col("value") * 8).cast("bigint")).alias("headway_seconds"),
        said(k % 5).alias("action"), said(user % 5).alias("llm_action"),
        F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("dispatcher_note"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers that contain a route proposal with the whole text as its reason, some of them broken."""
    n, d = F.col("n_chars"), F.col("doc_id")
    quoted = F.expr("to_json(named_struct('t', coalesce(text, '')))")
    reason = F.substr(quoted, F.lit(6), F.length(quoted) - 6)

    def point(i: int):
        lat = F.lit(40.25) + F.pmod(n * i, F.lit(64)) / 64
        return F.concat(F.lit("["), lat.cast("string"), F.lit(","), (F.lit(-74.25) + F.pmod(d * i, F.lit(32)) / 32).cast("string"), F.lit("]"))

    points = F.concat(F.lit("["), point(1), F.lit(","), F.when(d % 5 == 0, '["x", 1]').otherwise(point(2)), F.lit(","), point(3), F.lit("]"))
    body = F.concat(F.lit('{"name": "Line '), d.cast("string"), F.lit('", "waypoints": '), points,
                    F.lit(', "stops": ["'), "lang", F.lit('"], "rationale": '), reason, F.lit("}"))
    text = (F.when(d % 7 == 0, "no object here").when(d % 7 == 1, F.concat(body, F.lit(" }} trailing")))
            .otherwise(F.concat(F.lit("Proposal:\n"), body, F.lit("\nDone."))))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as questions to the copilots."""
    kind = F.when(F.col("turn") % 3 == 0, "rider").when(F.col("turn") % 3 == 1, "operator").otherwise("route")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), kind.alias("kind"),
        F.col("role").alias("origin"), F.lit(None).cast("string").alias("destination"),
        F.col("text").alias("question"), F.lit("").alias("constraints"))
