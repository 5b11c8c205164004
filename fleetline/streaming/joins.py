"""As-of joins, first and latest rows of streams, by closed stretches of event time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetline.functions.times import duration_seconds
from fleetline.operators.dedup import dedup_first, dedup_last
from fleetline.operators.enrich import station_bottlenecks, weather_impact
from fleetline.sinks.tables import CHANGE, exists, fold_changes, stored_changes
from fleetline.streaming.events import ALERT_DELAY, FEED_DELAY
from fleetline.streaming.slices import WIDTH, Closed, Side, closed_slices, micros, write_closed

EXPIRED = "expired"


def asof_stream(left: Side, right: Side, join: Callable[[DataFrame, DataFrame], DataFrame], tolerance: str, path: str,
                checkpoint: str, width: str = WIDTH, trigger: dict | None = None) -> StreamingQuery:
    """`join` of each closed stretch of left rows with the right rows that are at most `tolerance` older, in `path`/joined.

    No pair of rows is built that the join of tables does not build, and equal left rows stay apart.
    """
    def work(closed: Closed) -> None:
        write_closed(join(closed.due["left"], closed.with_past("right")), f"{path}/joined", closed.number)

    return closed_slices({"left": left, "right": right}, path, checkpoint, work, keep=tolerance, width=width, trigger=trigger)


def weather_impact_stream(alerts: DataFrame, weather: DataFrame, path: str, checkpoint: str, tolerance: str = "30 minutes",
                          observed: str = "event_time", width: str = WIDTH, trigger: dict | None = None) -> StreamingQuery:
    """Streaming form of `weather_impact`."""
    return asof_stream(Side(alerts, micros("arrival_time"), ALERT_DELAY), Side(weather, micros(observed), FEED_DELAY),
                       lambda a, w: weather_impact(a, w, tolerance, observed), tolerance, path, checkpoint, width, trigger)


def station_bottlenecks_stream(alerts: DataFrame, surges: DataFrame, path: str, checkpoint: str, within: str = "180 seconds",
                               width: str = WIDTH, trigger: dict | None = None) -> StreamingQuery:
    """Streaming form of `station_bottlenecks`; surge times are epoch milliseconds."""
    return asof_stream(Side(alerts, micros("arrival_time"), ALERT_DELAY), Side(surges, F.col("event_time") * 1000, FEED_DELAY),
                       lambda a, s: station_bottlenecks(a, s, within), within, path, checkpoint, width, trigger)


def _stored(spark: SparkSession, path: str, schema: T.StructType, number: int | None = None) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(CHANGE, T.LongType())])
    if not exists(spark, path):
        return spark.createDataFrame([], full)
    rows = stored_changes(spark, path, schema)
    return rows if number is None else rows.filter(F.col(CHANGE) < number)


def first_rows_stream(rows: DataFrame, keys: Sequence[str], ts: str, path: str, checkpoint: str, ties: Sequence[str] = (),
                      delay: str = FEED_DELAY, width: str = WIDTH, trigger: dict | None = None) -> StreamingQuery:
    """The earliest row of each key by event time, whatever the order of arrival within `delay`, in `path`/first."""
    def work(closed: Closed) -> None:
        first = dedup_first(closed.due["rows"], keys, ts, ties)
        known = _stored(closed.spark, f"{path}/first", rows.schema, closed.number).select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        write_closed(first.join(known, same, "left_anti"), f"{path}/first", closed.number)

    return closed_slices({"rows": Side(rows, micros(ts), delay)}, path, checkpoint, work, width=width, trigger=trigger)


def latest_state_stream(rows: DataFrame, at, keys: Sequence[str], ts: str, ttl: int, path: str, checkpoint: str,
                        ties: Sequence[str] = (), delay: str = FEED_DELAY, width: str = WIDTH, trigger: dict | None = None) -> StreamingQuery:
    """Streaming form of `latest_state`: a keyed table, in `path`/state, of the newest row of each key up to the mark.

    When the mark has passed a row's time to live, one more row with `expired` set hides it. `at` is the time in microseconds.
    """
    state = T.StructType([*rows.schema.fields, T.StructField(EXPIRED, T.BooleanType()), T.StructField("at", T.LongType())])

    def work(closed: Closed) -> None:
        fold_changes(closed.spark, f"{path}/state", state, keys, closed.number)
        newest = dedup_last(closed.due["rows"], keys, ts, ties).withColumns({EXPIRED: F.lit(False), "at": at})
        known = dedup_last(_stored(closed.spark, f"{path}/state", state, closed.number), keys, CHANGE).filter(~F.col(EXPIRED))
        both = dedup_last(newest.withColumn(CHANGE, F.lit(closed.number).cast("long")).unionByName(known), keys, CHANGE)
        over = F.col("at") < closed.mark - duration_seconds(ttl) * 1_000_000
        changed = both.withColumn(EXPIRED, over).filter(F.col(EXPIRED) | (F.col(CHANGE) == closed.number))
        write_closed(changed.drop(CHANGE), f"{path}/state", closed.number)

    return closed_slices({"rows": Side(rows, at, delay)}, path, checkpoint, work, width=width, trigger=trigger)


def read_latest_state(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The rows that have not expired at the last mark."""
    state = T.StructType([*schema.fields, T.StructField(EXPIRED, T.BooleanType())])
    return dedup_last(_stored(spark, f"{path}/state", state), keys, CHANGE).filter(~F.col(EXPIRED)).select(*schema.names)
