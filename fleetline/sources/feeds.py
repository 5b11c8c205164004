"""Live feeds as batch or streaming tables, with declared schemas."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetline import schemas


def read_feed(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False,
              fmt: str = "parquet", **options: str) -> DataFrame:
    """A feed landed as files; a stream reads what is there first, then what arrives."""
    reader = spark.readStream if stream else spark.read
    return reader.format(fmt).schema(schema).options(**options).load(path)


def read_vehicle_positions(spark: SparkSession, path: str, stream: bool = False, fmt: str = "parquet") -> DataFrame:
    return read_feed(spark, path, schemas.VEHICLE_POSITIONS, stream, fmt)


def read_trip_updates(spark: SparkSession, path: str, stream: bool = False, fmt: str = "parquet") -> DataFrame:
    return read_feed(spark, path, schemas.TRIP_UPDATES, stream, fmt)


def read_bus_positions(spark: SparkSession, path: str, stream: bool = False, fmt: str = "parquet") -> DataFrame:
    return read_feed(spark, path, schemas.BUS_POSITIONS, stream, fmt)


def read_service_alerts(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return read_feed(spark, path, schemas.SERVICE_ALERTS, stream, "json")


def read_weather_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Weather records, with the observation time as `event_time`."""
    raw = read_feed(spark, path, schemas.WEATHER_EVENTS, stream, "json")
    return raw.withColumn("event_time", F.col("current.time").try_cast("timestamp_ntz"))


def read_passenger_surges(spark: SparkSession, path: str, stream: bool = False, fmt: str = "parquet") -> DataFrame:
    return read_feed(spark, path, schemas.PASSENGER_SURGES, stream, fmt)


# Where a new reader of a table starts; of other tables it sees only what comes.
START = {"headway_alerts": "earliest", "dispatcher_decisions": "earliest", "headway_forecast": "earliest",
         "weather_events": "earliest", "passenger_surges": "earliest", "arrival_estimates": "tail"}
TAIL_ROWS = 250


def start_policy(table: str) -> str:
    """`earliest`, `latest` or `tail` (the last `TAIL_ROWS` records of each partition)."""
    return START.get(table, "latest")


def starting_offsets(policy: str, topic: str = "", ends: Mapping[int, int] | None = None, n: int = TAIL_ROWS) -> str:
    """Start of a broker read. `tail` needs the end offset of each partition of the topic."""
    if policy in ("earliest", "latest"):
        return policy
    if policy != "tail" or ends is None:
        raise ValueError("a tail needs the end offsets of the topic's partitions")
    return json.dumps({topic: {str(p): max(0, end - n) for p, end in sorted(ends.items())}})


def kafka_options(servers: str, topic: str, policy: str = "earliest", ends: Mapping[int, int] | None = None,
                  **extra: str) -> dict[str, str]:
    """Options for `spark.readStream.format("kafka")`; needs the connector on the class path."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic,
            "startingOffsets": starting_offsets(policy, topic, ends), **extra}


def starting_rows(df: DataFrame, table: str, order: Sequence[str], n: int = TAIL_ROWS) -> DataFrame:
    """What a new reader of a stored table starts with: all rows, none, or the last `n`."""
    policy = start_policy(table)
    return df if policy == "earliest" else tail_n(df, n, order) if policy == "tail" else df.limit(0)


def tail_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The last `n` rows in the given order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def merge_feeds(feeds: Mapping[str, DataFrame], selection: str | None = "all") -> DataFrame:
    """Union of the selected feeds. Unknown names are ignored; when none is left, all feeds are used."""
    wanted = [] if not selection or selection.strip().lower() == "all" else [
        k.strip() for k in selection.split(",") if k.strip() in feeds]
    chosen = [feeds[k] for k in wanted] or list(feeds.values())
    return reduce(DataFrame.unionByName, chosen)
