"""As-of join with a maximum age, split by time.

Both sides are cut into time slices no wider than needed, the newest right row of each slice is carried
into the following slices it can still serve, and one ordered pass per (key, slice) hands every left row
its newest right row. Work is linear in both inputs: no pair is built that is not in the result, and a
key holding most rows is spread over its slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions.times import duration_seconds, time_slice
from fleetline.operators.dedup import top_per_group

SLICE = "_slice"
SALT = "_salt"
SLICES_PER_TOLERANCE = 6
#: Tasks that the left rows of one slice are spread over where no key does it. Each gets a copy of the slice's right rows,
#: so slices are as wide as the tolerance there: a right row is carried into one further slice, not into six.
SALTS_WITHOUT_KEYS = 16


def _reachable(df: DataFrame, first: int, last: int) -> DataFrame:
    """One copy of each row per slice from `first` to `last` slices ahead of its own."""
    return df.withColumn(SLICE, F.explode(F.sequence(F.col(SLICE) + first, F.col(SLICE) + last)))


def asof_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, tolerance: str | int,
              keys: Sequence[str] = (), entity: Sequence[str] = (), ties: Sequence[str] = (),
              width: str | int | None = None, salts: int | None = None) -> DataFrame:
    """Left rows with the newest right row at or before them, at most `tolerance` old (inner).

    `width` is the slice width, unless given a sixth of the tolerance, or all of it where salts spread the rows;
    narrower slices spread one key over more tasks and carry one more row each. `keys` are equal on both sides. `entity` columns exist on the right only: a left row then gets one
    result per entity of its key that has a fresh enough row. `ties` orders right rows of equal time.
    `salts` spreads the left rows of one (key, slice) over as many tasks and copies its right rows to each; without
    keys it is `SALTS_WITHOUT_KEYS`, else 1. Give it where one key holds many left rows and few right ones.
    Right columns keep their names; they must not collide with left ones apart from `keys`.
    """
    limit = duration_seconds(tolerance)
    salts = salts or (1 if keys else SALTS_WITHOUT_KEYS)
    step = duration_seconds(width) if width else max(1, limit // (1 if salts > 1 else SLICES_PER_TOLERANCE))
    reach = -(-limit // step)
    group = [*keys, *entity]
    payload = [c for c in right.columns if c not in keys]

    present = F.lit(True)
    for c in (*keys, right_ts):
        present = present & F.col(c).isNotNull()
    readings = right.filter(present).withColumn(SLICE, time_slice(right_ts, step))
    order = [F.col(c).desc() for c in (right_ts, *ties)]
    carried = _reachable(top_per_group(readings, [*group, SLICE], order, 1), 1, reach)

    seekers = left.withColumn(SLICE, time_slice(left_ts, step))
    if entity:
        fresh = _reachable(readings.select(*group, SLICE).distinct(), 0, reach).distinct()
        seekers = seekers.join(fresh, [*keys, SLICE])

    left_row = F.struct(*left.columns)
    right_row = F.struct(*payload)
    no_left = F.lit(None).cast(left.select(left_row.alias("x")).schema["x"].dataType)
    no_right = F.lit(None).cast(right.select(right_row.alias("x")).schema["x"].dataType)
    rows = readings.unionByName(carried).withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        *group, SLICE, SALT, F.col(right_ts).cast("timestamp").alias("_at"), F.lit(0).alias("_side"),
        no_left.alias("_left"), right_row.alias("_right"))
    seekers = seekers.withColumn(SALT, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    rows = rows.unionByName(seekers.select(
        *group, SLICE, SALT, F.col(left_ts).cast("timestamp").alias("_at"), F.lit(1).alias("_side"),
        left_row.alias("_left"), no_right.alias("_right")))

    window = (Window.partitionBy(*group, SLICE, SALT)
              .orderBy("_at", "_side", *[F.col(f"_right.{t}") for t in ties])
              .rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_right", F.last("_right", ignorenulls=True).over(window))
    age = F.unix_micros("_at") - F.unix_micros(F.col(f"_right.{right_ts}").cast("timestamp"))
    return found.filter((F.col("_side") == 1) & (age <= limit * 1_000_000)).select(
        "_left.*", *[F.col(f"_right.{c}") for c in payload])
