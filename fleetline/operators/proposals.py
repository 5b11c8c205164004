"""Route proposals: find the JSON object in an answer, keep valid points, turn it into a map line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.functions.jsons import json_object
from fleetline.schemas import array, struct

# Accepted coordinate box.
LAT_RANGE = (40.3, 41.1)
LON_RANGE = (-74.3, -73.6)

PROPOSAL = struct(name="string", waypoints=array("string"), stops=array("string"), rationale="string",
                  connections=array("string"))


def object_text(text: Column) -> Column:
    """The text from its first opening to its last closing brace; null when there is none."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    found = (first > 0) & (F.instr(text, "}") > 0) & (last > first)
    return F.when(found, F.substring(text, first, last - first + 1))


def _point(raw: Column) -> Column:
    pair = F.from_json(raw, "array<string>")
    return F.array(F.try_element_at(pair, F.lit(1)).try_cast("double"),
                   F.try_element_at(pair, F.lit(2)).try_cast("double"))


def parse_route_proposals(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds name, waypoints, stops, rationale and connections; all null unless two points are valid."""
    points = F.transform("_obj.waypoints", _point)
    valid = F.filter(points, lambda p: p[0].between(*LAT_RANGE) & p[1].between(*LON_RANGE))
    parsed = df.withColumn("_obj", json_object(object_text(F.col(text)), PROPOSAL))
    parsed = parsed.withColumn("_points", valid)
    usable = F.size("_points") >= 2
    return parsed.select(
        *df.columns, F.when(usable, F.col("_obj.name")).alias("name"),
        F.when(usable, F.col("_points")).alias("waypoints"),
        *[F.when(usable, F.col(f"_obj.{c}")).alias(c) for c in ("stops", "rationale", "connections")])


def line_feature(coordinates: Column, properties: Column) -> Column:
    """A GeoJSON line feature as text."""
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                              properties.alias("properties")))


def proposal_geojson(df: DataFrame, name: str = "geojson") -> DataFrame:
    """Adds the proposal as a line feature; GeoJSON wants longitude first."""
    swapped = F.transform("waypoints", lambda p: F.array(p[1], p[0]))
    properties = F.struct(F.coalesce(F.col("name"), F.lit("Proposed route")).alias("name"),
                          F.lit("proposed_route").alias("kind"))
    return df.withColumn(name, F.when(F.col("waypoints").isNotNull(), line_feature(swapped, properties)))
