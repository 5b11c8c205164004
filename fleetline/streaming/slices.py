"""Closed stretches of event time, each handed once to a batch operator.

Rows of one or several streams are kept in a table, by slices of event time, until the mark has passed them. The mark is
the latest time seen, less the lateness bound, and of several streams the least; it is stored with every batch. When it
moves, the rows between the old mark and the new one are complete and in order, and `work` gets them as tables, with
those of the `keep` before. So streams use the operators of tables, split and shuffled like them, with no state but
files: nothing waits in a task's memory, and a row that comes at or before the mark is dropped.

A batch that is replayed replaces its own files; its number is written last and marks it as done.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetline.functions.times import duration_seconds
from fleetline.sinks.tables import CHANGE, child_names, exists, has_change

SLICE = "slice"
NEVER = -(1 << 62)
#: Width of a folder of waiting rows. A batch opens the folders that its stretch touches; take wider ones for sparse data.
WIDTH = "1 hour"


@dataclass(frozen=True)
class Side:
    """A stream, its time in microseconds, and how late rows may come."""

    rows: DataFrame
    at: Column
    delay: str


@dataclass(frozen=True)
class Closed:
    """Complete rows after the mark `before` up to `mark` (microseconds), and those of the stretch kept before it."""

    spark: SparkSession
    number: int
    before: int
    mark: int
    due: dict[str, DataFrame]
    past: dict[str, DataFrame]

    def with_past(self, side: str) -> DataFrame:
        return self.past[side].unionByName(self.due[side])


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _together(sides: dict[str, Side]) -> DataFrame:
    """One stream of (side, at, and a column for each side with its row or null)."""
    out = None
    for name, side in sides.items():
        row = [F.struct(*s.rows.columns) if n == name else F.lit(None).cast(s.rows.schema) for n, s in sides.items()]
        part = side.rows.select(F.lit(name).alias("side"), side.at.alias("at"), *[c.alias(n) for c, n in zip(row, sides)])
        out = part if out is None else out.unionByName(part)
    return out.filter("at IS NOT NULL")


def _last_mark(spark: SparkSession, path: str, number: int) -> dict:
    """What the last finished batch before `number` wrote."""
    done = [int(n.split("=")[1]) for n in child_names(spark, f"{path}/marks") if n.startswith(f"{CHANGE}=")]
    done = [n for n in sorted(done, reverse=True) if n < number and has_change(spark, f"{path}/marks", n)]
    if not done:
        return {"mark": NEVER, "seen": {}}
    row = spark.read.schema("mark long, seen map<string,long>").json(f"{path}/marks/{CHANGE}={done[0]}").first()
    return {"mark": row["mark"], "seen": row["seen"]}


def _pending(spark: SparkSession, path: str, schema: T.StructType, low: int, high: int, width: int) -> DataFrame:
    """Kept rows after `low` up to `high`, from the folders of their slices alone."""
    names = [n for n in child_names(spark, path) if n.startswith(f"{SLICE}=") and low // width <= int(n.split("=")[1]) <= high // width]
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{path}/{n}/*" for n in names])
    return rows.filter((F.col("at") > low) & (F.col("at") <= high)).select(*schema.names)


def closed_slices(sides: dict[str, Side], path: str, checkpoint: str, work: Callable[[Closed], None], keep: str | int = 0,
                  width: str = WIDTH, trigger: dict | None = None) -> StreamingQuery:
    """Runs `work` on every closed stretch. It writes tables below `path`, a folder `change=<number>` each time (`write_closed`)."""
    together = _together(sides)
    width_us, keep_us = (duration_seconds(x) * 1_000_000 for x in (width, keep))
    schema = together.schema

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if has_change(spark, f"{path}/marks", number):
            return
        last = _last_mark(spark, path, number)
        before = last["mark"]
        found = Observation()
        rows = batch.filter(F.col("at") > before).observe(found, *[
            F.max(F.when(F.col("side") == s, F.col("at"))).alias(s) for s in sides])
        rows = rows.withColumns({SLICE: F.floor(F.col("at") / width_us).cast("long"), CHANGE: F.lit(number)})
        # Only the folders of this batch are replaced.
        (rows.hint("rebalance", SLICE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(SLICE, CHANGE).parquet(f"{path}/pending"))
        seen = dict(last["seen"])
        for side, at in found.get.items():
            if at is not None:
                seen[side] = max(at, seen.get(side, at))
        mark = before
        if len(seen) == len(sides):
            mark = max(before, min(seen[n] - duration_seconds(s.delay) * 1_000_000 for n, s in sides.items()))
        if mark > before:
            kept = _pending(spark, f"{path}/pending", schema, max(before, NEVER + keep_us) - keep_us, mark, width_us)
            due, past = ({n: kept.filter((F.col("side") == n) & when).select(f"{n}.*") for n in sides}
                         for when in (F.col("at") > before, F.col("at") <= before))
            work(Closed(spark, number, before, mark, due, past))
        spark.createDataFrame([(mark, seen)], "mark long, seen map<string,long>").coalesce(1).write.mode("overwrite").json(
            f"{path}/marks/{CHANGE}={number}")

    return (together.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def write_closed(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{CHANGE}={number}")


def read_closed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that `write_closed` has written there."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{CHANGE}=*").select(*schema.names)
