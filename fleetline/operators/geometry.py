"""Route lines from static shape points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetline.operators.dedup import dedup_first, top_per_group
from fleetline.operators.proposals import line_feature

_BAND = "_band"


def numbered_points(points: DataFrame, key: str = "shape_id", band: int = 1000) -> DataFrame:
    """Adds `position`, the 0-based place of each point along its shape.

    Shapes are cut into bands of sequence numbers that are numbered separately and then offset, so one
    very long shape is spread over many tasks.
    """
    order = ["shape_pt_sequence", "shape_pt_lat", "shape_pt_lon"]
    banded = points.withColumn(_BAND, F.floor(F.col("shape_pt_sequence") / band).cast("long"))
    sizes = banded.groupBy(key, _BAND).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy(_BAND).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, _BAND, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, _BAND).orderBy(*order)
    numbered = banded.withColumn("_i", F.row_number().over(inside)).join(offsets, [key, _BAND])
    return numbered.withColumn("position", F.col("_offset") + F.col("_i") - 1).select(*points.columns, "position")


def trunk_shapes(shapes: DataFrame, trips: DataFrame, order: str = "trip_order") -> DataFrame:
    """The shape with the most points per route; a shape belongs to the first route that uses it.

    Equal sizes fall to the shape that comes first by `point_order`, where the points have that column,
    then to the smaller shape id.
    """
    first = F.min("point_order") if "point_order" in shapes.columns else F.lit(0)
    owners = trips.filter((F.trim("shape_id") != "") & (F.trim("route_id") != ""))
    owners = dedup_first(owners.select("shape_id", "route_id", order), ["shape_id"], order, ("route_id",))
    sizes = shapes.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_points"), first.alias("_first"))
    owned = sizes.join(owners.select("shape_id", "route_id"), "shape_id")
    return top_per_group(owned, ["route_id"], [F.col("n_points").desc(), "_first", "shape_id"], 1).select(
        "route_id", "shape_id", "n_points")


def route_shapes(shapes: DataFrame, trips: DataFrame, routes: DataFrame, order: str = "trip_order") -> DataFrame:
    """Ordered points of every route's trunk shape, with the route colour."""
    trunks = trunk_shapes(shapes, trips, order).filter("n_points >= 2").select("route_id", "shape_id")
    colour = F.when(F.trim("route_color") != "", F.concat(F.lit("#"), F.trim("route_color")))
    colours = routes.filter(F.trim("route_id") != "").groupBy("route_id").agg(F.max(colour).alias("_color"))
    lines = trunks.join(colours, "route_id", "left").select(
        "shape_id", "route_id", F.coalesce("_color", F.lit("#888888")).alias("color"))
    chosen = shapes.select("shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon").join(lines, "shape_id")
    return numbered_points(chosen).select(
        "route_id", "shape_id", "color", "position", F.col("shape_pt_lat").alias("lat"),
        F.col("shape_pt_lon").alias("lon"))


def to_geojson_features(points: DataFrame, mode: str = "subway", max_points: int = 20000) -> DataFrame:
    """Line features as text, each with its `part` of the route's line, from 0.

    A part ends after `max_points` points; neighbours share their border point, so no stretch is lost and no row
    grows with the data. Short lines are part 0 alone.
    """
    part = F.floor(F.col("position") / max_points).cast("long")
    border = (F.col("position") > 0) & (F.col("position") % max_points == 0)
    parts = points.withColumn("_part", F.explode(F.when(border, F.array(part - 1, part)).otherwise(F.array(part))))
    lines = parts.groupBy("route_id", "color", "_part").agg(
        F.array_sort(F.collect_list(F.struct("position", "lon", "lat"))).alias("_line"))
    lines = lines.filter(F.size("_line") >= 2)
    coordinates = F.transform("_line", lambda p: F.array(p["lon"], p["lat"]))
    properties = F.struct("route_id", F.col("route_id").alias("route_short"), F.lit(mode).alias("mode"),
                          "color", F.col("_part").alias("part"))
    return lines.select("route_id", F.col("_part").alias("part"),
                        line_feature(coordinates, properties).alias("feature"))
