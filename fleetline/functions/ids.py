"""Identifier helpers: stop suffixes, agency prefixes, fallbacks for blank keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\r\x0b\x0c"


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACES))


def blank_to(column: Column, fallback: Column) -> Column:
    """`fallback` where the value is null or empty."""
    return F.coalesce(F.nullif(column, F.lit("")), fallback)


def _suffix(column: Column) -> Column:
    return F.right(column, F.lit(1))


def direction(stop: Column, trip: Column) -> Column:
    """N or S from the stop id's last letter, else from the trip id's, else U."""
    return (
        F.when(_suffix(stop).isin("N", "S"), _suffix(stop))
        .when(_suffix(trip).isin("N", "S"), _suffix(trip))
        .otherwise("U")
    )


def base_id(stop: Column) -> Column:
    """Stop id without its direction letter."""
    return F.when(
        _suffix(stop).isin("N", "S"), F.substring(stop, F.lit(1), F.length(stop) - 1)
    ).otherwise(stop)


def route_short(route: Column) -> Column:
    """Rider-facing route name: what follows the first underscore."""
    cut = F.instr(route, "_")
    return strip(F.when(cut > 0, F.substring(route, cut + 1, F.length(route)))
                 .otherwise(F.coalesce(route, F.lit(""))))


def agency_of(vehicle: Column) -> Column:
    """What precedes the first underscore, or an empty string when there is none."""
    return F.when(F.instr(vehicle, "_") > 0, strip(F.substring_index(vehicle, "_", 1))).otherwise("")


def agency_selected(vehicle: Column, selection: str | None = "all") -> Column:
    """True when the vehicle's agency is in a comma-separated list (any case), or for `all`."""
    if not selection or selection.strip().lower() == "all":
        return F.lit(True)
    wanted = [part.strip().upper() for part in selection.split(",") if part.strip()]
    return F.upper(agency_of(vehicle)).isin(*wanted)


def arrival_keys(df: DataFrame) -> DataFrame:
    """Fill blank trip and stop ids from their fallbacks and drop rows that still have none."""
    have = set(df.columns)
    text = {c: F.col(c) if c in have else F.lit(None).cast("string")
            for c in ("trip_id", "curr_trip", "route_id", "direction", "stop_id", "stop_name")}
    made_up = F.concat_ws("-", *[F.coalesce(text[c], F.lit("None"))
                                 for c in ("route_id", "direction", "stop_name")])
    return (
        df.withColumn("trip_id", blank_to(text["trip_id"], blank_to(text["curr_trip"], made_up)))
        .withColumn("stop_id", blank_to(text["stop_id"], text["stop_name"]))
        .filter((F.col("stop_id").isNotNull()) & (F.col("stop_id") != ""))
    )
