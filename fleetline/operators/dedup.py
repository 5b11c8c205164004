"""Keep one row per key, or the first few per group.

`row_number() <= k` is planned with a group limit before the shuffle, so a key that holds a large
share of all rows reaches its reducer as at most k rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_rank"


def _orders(columns: Sequence[str | Column], descending: bool) -> list[Column]:
    out = []
    for c in columns:
        if isinstance(c, Column):
            out.append(c)
        else:
            out.append(F.col(c).desc() if descending else F.col(c).asc())
    return out


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int,
                  rank: str | None = None) -> DataFrame:
    """The first `k` rows of each group; `rank` keeps the row number under that name."""
    name = rank or _RANK
    window = Window.partitionBy(*keys).orderBy(*_orders(order, False))
    kept = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return kept.withColumn(name, F.col(name).cast("long")) if rank else kept.drop(name)


def dedup_first(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = ()) -> DataFrame:
    """Earliest row per key."""
    return top_per_group(df, keys, _orders([order, *ties], False), 1)


def dedup_last(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = ()) -> DataFrame:
    """Latest row per key."""
    return top_per_group(df, keys, _orders([order, *ties], True), 1)


ALERT_IDENTITY = ("route_id", "direction", "stop_id", "curr_trip", "prev_trip")


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """First bunching or gap alert per (route, direction, stop, vehicle pair)."""
    relevant = alerts.filter(F.col("alert_type").isin("BUNCHING", "GAP"))
    return dedup_first(relevant, ALERT_IDENTITY, "arrival_time", ("headway_seconds",))


def active_service_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter((F.col("status_label").isNotNull()) & (F.col("status_label") != "")).select(
        "event_id", "agency", "affected", "status_label", "header", "description", "date")


def latest_service_alerts(alerts: DataFrame) -> DataFrame:
    """Newest update per event; equal dates fall back to the higher update number."""
    latest = dedup_last(alerts, ["event_id"], "date", ("update_number", "alert_id"))
    return latest.select("event_id", "agency", "affected", "status_label", "header", "description", "date")
