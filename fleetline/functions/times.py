"""Time helpers that treat zone-less, zoned and epoch-millisecond columns alike."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def duration_seconds(text: str | int) -> int:
    """`"5 minutes"` -> 300; plain numbers are seconds already."""
    if isinstance(text, int):
        return text
    amount, unit = text.split()
    return int(amount) * UNIT_SECONDS[unit.lower().rstrip("s")]


def as_epoch(as_of: datetime | str | int | float) -> float:
    """Any of the accepted `as_of` forms as epoch seconds; naive values are UTC."""
    if isinstance(as_of, (int, float)):
        return as_of
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    return as_of.timestamp()


def instant(df: DataFrame, ts: str, epoch: float) -> Column:
    """A literal of the column's own type, so that the comparison reaches the Parquet scan."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.LongType):
        return F.lit(int(epoch * 1000))
    text = datetime.fromtimestamp(epoch, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "+00:00").cast("timestamp")


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 for a zoned or zone-less timestamp."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(column.cast("timestamp"))


def seconds_between(earlier: Column, later: Column) -> Column:
    """Elapsed whole seconds, truncated toward zero."""
    return F.timestamp_diff("SECOND", earlier, later)


def time_slice(ts: str | Column, width: str | int) -> Column:
    """Number of the fixed-width time slice that holds the timestamp."""
    return F.floor(epoch_seconds(ts) / F.lit(duration_seconds(width))).cast("long")


def from_epoch_ms(column: Column) -> Column:
    """Epoch milliseconds as a zone-less UTC timestamp."""
    return F.timestamp_millis(column).cast("timestamp_ntz")


def window_time(window: Column) -> Column:
    """The last millisecond that belongs to a window."""
    return window["end"] - F.expr("INTERVAL '0.001' SECOND")
