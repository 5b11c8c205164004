"""The live view as text lines for a text model."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.functions.ids import blank_to
from fleetline.operators.aggregate import top_routes
from fleetline.operators.snapshot import BOARD_ORDER

MAX_LISTED = 40
MAX_SURGES = 5

# Section headings of the text.
HEADINGS = {
    4: "HEADWAY ALERTS (route/type/severity @ stop, headway secs):",
    5: "FLINK DISPATCHER RECOMMENDATIONS (already issued by the streaming agent):",
    6: "NEXT ARRIVALS (route @ stop in N sec):",
}
TITLES = {2: "SUBWAY LINES RUNNING: ", 3: "BUS ROUTES RUNNING: ", 8: "STATION PASSENGER SURGES: "}


def _text(*parts: str | Column) -> Column:
    """Concatenation in which a missing value reads `None`."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None"))
                      for p in parts])


NAMES = 4


def _part(rows: DataFrame, section: int | Column, line: Column, number: str | Column | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """Lines with what orders them within their section: a number, then up to four names."""
    by = F.lit(None) if number is None else F.col(number) if isinstance(number, str) else number
    filled = [F.col(n).cast("string") for n in names] + [F.lit("")] * (NAMES - len(names))
    place = F.lit(section) if isinstance(section, int) else section
    return rows.select(place.alias("section"), by.cast("double").alias("number"), *[n.alias(f"name{i}") for i, n in enumerate(filled)],
                       line.alias("line"))


def context_rows(snap: Mapping[str, DataFrame]) -> DataFrame:
    """All lines of the text with what orders them, from the parts `snapshot` returns; lists are cut to the lengths shown.

    A short table made in one job. Store it to read the feeds once for several texts.
    """
    c = F.col
    live = snap["live"].select(F.max("live")).scalar()
    flag = F.when(F.coalesce(live, F.lit(False)), "True").otherwise("False")
    place = blank_to(c("stop_name"), c("stop_id"))
    temp = F.when(c("temp_f").isNotNull(), _text(c("temp_f"), "°F (", c("temp_c"), "°C)")).otherwise("N/A")
    stop = ("route_id", "direction", "stop_id")
    newest = [c("ts").desc(), *stop]
    alerts = snap["alerts"].orderBy(*newest, "curr_trip").limit(MAX_LISTED)
    decisions = snap["decisions"].orderBy(*newest, "dispatcher_note").limit(MAX_LISTED)
    arrivals = snap["arrivals"].orderBy(*BOARD_ORDER).limit(MAX_LISTED)
    surges = snap["surges"].orderBy("station_id").limit(MAX_SURGES)
    return reduce(DataFrame.unionByName, [
        _part(snap["counts"], 1, _text("LIVE FLEET: ", c("trains"), " subway trains, ", c("buses"), " buses, ", c("routes"),
                                        " active routes, ", c("alerts"), " headway alerts. data_live=", flag)),
        _part(top_routes(snap["all_vehicles"]), F.when(c("mode") == "subway", 2).otherwise(3), _text(c("route_short"), "(", c("vehicles"), ")"), "position"),
        _part(alerts, 4, _text("  - ", c("route_id"), " ", c("alert_type"), " [", c("severity"), "] @ ", place,
                                        " (", c("headway_seconds"), "s)"), -c("ts"), (*stop, "curr_trip")),
        _part(decisions, 5, _text("  - ", c("route_id"), ": ", c("action"), " — ", c("dispatcher_note")),
              -c("ts"), (*stop, "dispatcher_note")),
        _part(arrivals, 6, _text("  - ", c("route_id"), " @ ", place, " in ", c("eta_seconds"), "s"), BOARD_ORDER[0], BOARD_ORDER[1:]),
        _part(snap["weather"], 7, _text("WEATHER: ", c("condition"), ", ", temp, ", rain: ", c("precip_mm"), "mm, wind: ",
                                         c("wind_kph"), " km/h")),
        _part(surges, 8, _text(c("station_name"), " [", c("line"), "] (", c("crowd_level"), ", ", c("taps_per_minute"),
                                        " taps/min)"), None, ("station_id",))])


def _sections(rows: DataFrame) -> DataFrame:
    """Rows (section, lines), lines being structs of a number and a text. All lines meet in one shuffle by section."""
    c = F.col
    order = F.struct(F.col("number").isNull().alias("last"), "number", *[f"name{i}" for i in range(NAMES)], "line")
    listed = rows.groupBy("section").agg(F.array_sort(F.collect_list(order)).alias("found"))
    texts = F.transform("found", lambda x: x["line"])
    heading = F.create_map(*[F.lit(v) for item in {**HEADINGS, **TITLES}.items() for v in item])[c("section")]
    single = F.concat(F.coalesce(heading, F.lit("")), F.array_join(texts, ", "))
    lines = F.when(c("section").isin(*HEADINGS), F.concat(F.array(heading), texts)).otherwise(F.array(single))
    return listed.select("section", F.transform(lines, lambda t, i: F.struct(i.cast("long").alias("ord"), t.alias("line"))).alias("lines"))


def context_lines(rows: DataFrame) -> DataFrame:
    """Rows (section, ord, line) built from `context_rows`."""
    return _sections(rows).select("section", F.inline("lines"))


def context_text(rows: DataFrame) -> DataFrame:
    """The lines as one text: one row, bounded by the list caps."""
    in_order = F.array_sort(F.collect_list(F.struct("section", "lines")))
    texts = F.transform(F.flatten(F.transform(in_order, lambda s: s["lines"])), lambda x: x["line"])
    return _sections(rows).agg(F.array_join(texts, "\n").alias("text"))
