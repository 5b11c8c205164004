"""Learned bounds and trend forecasts per stop, from the stop's own recent headways.

There is no public definition of the managed models these stand for. The anomaly test here is a normal band around
the mean of the previous headways, the forecast a least-squares line through the latest ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.functions.rules import BUNCH_BELOW, GAP_ABOVE
from fleetline.operators.sequence import (
    LONG_SLICE, STOP_KEYS, slice_window, with_carried_rows, without_carried_rows)


def detect_anomalies(df: DataFrame, value: str = "headway_seconds", partition: Sequence[str] = STOP_KEYS,
                     order: Sequence[str] = ("arrival_time", "curr_trip"), min_n: int = 12, max_n: int = 100,
                     confidence: float = 0.99, width: str | int = LONG_SLICE) -> DataFrame:
    """Adds actual_value, lower_bound, upper_bound and is_anomaly; bounds are null before `min_n` rows."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    padded = with_carried_rows(df, partition, order, max_n, width)
    before = slice_window(partition, order).rowsBetween(-max_n, -1)
    x = F.col(value).cast("double")
    enough = F.count(x).over(before) >= min_n
    mean, spread = F.avg(x).over(before), F.stddev_samp(x).over(before)
    scored = (
        padded.withColumn("actual_value", x)
        .withColumn("lower_bound", F.when(enough, F.round(mean - z * spread, 6)))
        .withColumn("upper_bound", F.when(enough, F.round(mean + z * spread, 6)))
    )
    actual = F.col("actual_value")
    out = (actual < F.col("lower_bound")) | (actual > F.col("upper_bound"))
    return without_carried_rows(scored.withColumn("is_anomaly", F.coalesce(out, F.lit(False))))


def anomaly_alerts(headways: DataFrame, **options) -> DataFrame:
    """Headways outside their stop's own band, in the shape of the threshold alerts."""
    kind = F.when(F.col("actual_value") < F.col("lower_bound"), "BUNCHING").otherwise("GAP")
    return (
        detect_anomalies(headways, **options).filter("is_anomaly")
        .select("route_id", "direction", "stop_id", "stop_name", "stop_lat", "stop_lon", "prev_trip",
                "curr_trip", "headway_seconds", kind.alias("alert_type"), F.lit("MEDIUM").alias("severity"),
                "arrival_time")
    )


def forecast_next(df: DataFrame, value: str = "headway_seconds", partition: Sequence[str] = STOP_KEYS,
                  order: Sequence[str] = ("arrival_time", "curr_trip"), min_n: int = 12, max_n: int = 100,
                  horizon: int = 1, width: str | int = LONG_SLICE) -> DataFrame:
    """Adds forecast_value: the fitted line `horizon` rows ahead, null before `min_n` rows.

    Rows without a value are left out. Rows are numbered, so with x counted back from the current row the
    sums over x are known and only two sums over the values are needed.
    """
    padded = with_carried_rows(df.filter(F.col(value).isNotNull()), partition, order, max_n - 1, width)
    window = slice_window(partition, order)
    latest = window.rowsBetween(-(max_n - 1), 0)
    y, x = F.col(value).cast("double"), F.col("_x")
    sums = (
        padded.withColumn("_x", F.row_number().over(window).cast("double"))
        .withColumn("_sum", F.sum(y).over(latest)).withColumn("_moment", F.sum(x * y).over(latest))
    )
    n, total = F.least(x, F.lit(float(max_n))), F.col("_sum")
    moment = F.col("_moment") - x * total
    sum_x, sum_xx = -n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    slope = (n * moment - sum_x * total) / (n * sum_xx - sum_x * sum_x)
    ahead = (total - slope * sum_x) / n + slope * horizon
    fitted = sums.withColumn("forecast_value", F.when(n >= max(min_n, 2), F.round(ahead, 3)))
    return without_carried_rows(fitted.drop("_x", "_sum", "_moment"))


def trend_forecasts(headways: DataFrame, bunch: int = BUNCH_BELOW, gap: int = GAP_ABOVE, **options) -> DataFrame:
    """Forecasts outside the bounds, in the shape of the straight-line headway forecast."""
    ahead = F.col("forecast_value")
    return (
        forecast_next(headways, **options).filter((ahead < bunch) | (ahead > gap))
        .select("route_id", "direction", "stop_id", "stop_name", "stop_lat", "stop_lon", "curr_trip",
                "headway_seconds", F.lit(None).cast("long").alias("prev_headway_seconds"),
                ahead.cast("long").alias("predicted_headway"),
                F.when(ahead < bunch, "PREDICTED_BUNCHING").otherwise("PREDICTED_GAP").alias("forecast_type"),
                "arrival_time")
    )
