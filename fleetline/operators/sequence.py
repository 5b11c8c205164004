"""Matching of consecutive rows, split by time so that a busy key never lands in one task.

A plain `lag` over (route, direction, stop) sends all rows of a key to one task. Here keys are cut into
time slices and the last rows before a slice are carried into it, so the window runs on (key, slice) and
still sees the true predecessors across slice borders:

1. the last `n` rows of every (key, slice), group-limited before the shuffle;
2. on those few rows only, the `n` rows that precede each slice's first row;
3. the data plus the carried rows, one shuffle on (key, slice), ordinary window functions.

Step 2 orders n rows per slice of a key: its size follows the number of slices, not the row count.
All keys are cut by the same width: an hour for short look-backs, `LONG_SLICE` for long ones.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions.rules import BUNCH_BELOW, GAP_ABOVE, forecast_type
from fleetline.functions.times import seconds_between, time_slice

SLICE = "_slice"
CARRIED = "_carried"
_RANK = "_rank"


#: Slice width for long look-backs. A slice should hold several times the look-back of a usual key, as each carries
#: that many rows more.
LONG_SLICE = "7 days"


def _tails(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    newest = Window.partitionBy(*keys, SLICE).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(_RANK, F.row_number().over(newest)).filter(F.col(_RANK) <= n).drop(_RANK)


def with_carried_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
                      width: str | int = "1 hour") -> DataFrame:
    """`df` with a slice number, plus up to `n` predecessor rows (flagged) at the head of each slice.

    The first column of `order` is the time.
    """
    columns = df.columns
    sliced = df.withColumn(SLICE, time_slice(order[0], width))
    tails = _tails(sliced, keys, order, n)
    out = sliced.withColumn(CARRIED, F.lit(False))
    if n <= 4:
        along_key = Window.partitionBy(*keys).orderBy(SLICE, *order)
        heads = F.lag(SLICE).over(along_key) < F.col(SLICE)
        # Column by column, so that columns nobody uses are pruned here as in the data itself and both
        # read the same shuffle.
        earlier = tails.select(SLICE, heads.alias("_heads"), F.least(F.row_number().over(along_key) - 1, F.lit(n)).alias("_found"),
                               *[F.array(*[F.lag(c, back).over(along_key) for back in range(1, n + 1)]).alias(c) for c in columns])
        carried = earlier.filter("_heads").withColumn("_back", F.explode(F.sequence(F.lit(0), F.col("_found") - 1)))
        return out.unionByName(carried.select(SLICE, F.lit(True).alias(CARRIED), *[F.get(c, "_back").alias(c) for c in columns]))
    # One row for each slice holds its last rows; the n before a slice are the last of up to n slices before it.
    row = F.struct(*order, *[c for c in columns if c not in order])
    by_slice = tails.groupBy(*keys, SLICE).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    earlier = F.flatten(F.collect_list("_rows").over(Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(-n, -1)))
    newest = F.slice("_before", F.greatest(F.size("_before") - n + 1, F.lit(1)), n)
    return out.unionByName(
        by_slice.select(SLICE, earlier.alias("_before")).select(SLICE, F.explode(newest).alias("_row"))
        .select(SLICE, F.lit(True).alias(CARRIED), "_row.*"))


def slice_window(keys: Sequence[str], order: Sequence[str]):
    """The window to use on the output of `with_carried_rows`."""
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def without_carried_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(CARRIED)).drop(CARRIED, SLICE)


Row = Callable[[str], Column]


def match_consecutive(df: DataFrame, partition: Sequence[str], order: Sequence[str],
                      steps: Sequence[str], define: Mapping[str, Callable[[Mapping[str, Row]], Column]],
                      measures: Mapping[str, Callable[[Mapping[str, Row]], Column]],
                      width: str | int = "1 hour") -> DataFrame:
    """Fixed-length contiguous pattern, one match attempt per row.

    `steps` names the rows of the pattern, oldest first. `define` and `measures` receive a mapping from
    step name to a function `column name -> Column`. Output: the partition columns and the measures.
    """
    n = len(steps) - 1
    padded = with_carried_rows(df, partition, order, n, width)
    window = slice_window(partition, order)

    def row(back: int) -> Row:
        return F.col if back == 0 else lambda c: F.lag(c, back).over(window)

    rows = {name: row(n - i) for i, name in enumerate(steps)}
    matches = F.lag(F.lit(True), n, False).over(window)
    for condition in define.values():
        matches = matches & condition(rows)
    return (
        padded.select(*partition, *[m(rows).alias(k) for k, m in measures.items()],
                      (matches & ~F.col(CARRIED)).alias("_matches"))
        .filter("_matches").drop("_matches")
    )


STOP_KEYS = ("route_id", "direction", "stop_id")


def headway(arrivals: DataFrame, partition: Sequence[str] = STOP_KEYS, order: str = "event_time",
            entity: str = "trip_id", width: str | int = "1 hour", also: Sequence[str] = ()) -> DataFrame:
    """Seconds between consecutive arrivals of different vehicles at the same stop, with further columns of the later one."""
    return match_consecutive(
        arrivals, partition, (order, entity), ("A", "B"),
        {"B": lambda m: m["B"](entity) != m["A"](entity)},
        {
            "stop_name": lambda m: m["B"]("stop_name"),
            "stop_lat": lambda m: m["B"]("stop_lat"),
            "stop_lon": lambda m: m["B"]("stop_lon"),
            "prev_trip": lambda m: m["A"](entity),
            "curr_trip": lambda m: m["B"](entity),
            "headway_seconds": lambda m: seconds_between(m["A"](order), m["B"](order)),
            "arrival_time": lambda m: m["B"](order),
            **{c: lambda m, c=c: m["B"](c) for c in also},
        },
        width,
    )


def headway_triplets(arrivals: DataFrame, partition: Sequence[str] = STOP_KEYS, order: str = "event_time",
                     entity: str = "trip_id", width: str | int = "1 hour", also: Sequence[str] = ()) -> DataFrame:
    """Two consecutive headways and their straight-line continuation."""
    pairs = match_consecutive(
        arrivals, partition, (order, entity), ("A", "B", "C"),
        {"B": lambda m: m["B"](entity) != m["A"](entity),
         "C": lambda m: m["C"](entity) != m["B"](entity)},
        {
            "stop_name": lambda m: m["C"]("stop_name"),
            "stop_lat": lambda m: m["C"]("stop_lat"),
            "stop_lon": lambda m: m["C"]("stop_lon"),
            "curr_trip": lambda m: m["C"](entity),
            "headway_seconds": lambda m: seconds_between(m["B"](order), m["C"](order)),
            "prev_headway_seconds": lambda m: seconds_between(m["A"](order), m["B"](order)),
            "arrival_time": lambda m: m["C"](order),
            **{c: lambda m, c=c: m["C"](c) for c in also},
        },
        width,
    )
    return pairs.withColumn("predicted_headway",
                            F.col("headway_seconds") * 2 - F.col("prev_headway_seconds"))


def headway_forecast(arrivals: DataFrame, bunch: int = BUNCH_BELOW, gap: int = GAP_ABOVE,
                     width: str | int = "1 hour", also: Sequence[str] = ()) -> DataFrame:
    """Triplets whose next headway is about to cross a bound."""
    kind = forecast_type(F.col("predicted_headway"), F.col("headway_seconds"), bunch, gap)
    return (
        headway_triplets(arrivals, width=width, also=also)
        .withColumn("forecast_type", kind)
        .filter(F.col("forecast_type") != "STABLE")
        .select("route_id", "direction", "stop_id", "stop_name", "stop_lat", "stop_lon", "curr_trip",
                "headway_seconds", "prev_headway_seconds", "predicted_headway", "forecast_type",
                "arrival_time", *also)
    )
