"""Static reference tables from CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.functions.ids import strip
from fleetline.operators.dedup import dedup_last


LINE = "_line"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, plus the row's place in the file; a leading byte-order mark is dropped."""
    df = spark.read.csv(path, header=True, mode="PERMISSIVE", escape='"')
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    names = [c.lstrip("\ufeff").strip() for c in df.columns]
    return df.withColumn(LINE, place).toDF(*names, LINE)


def _number(name: str, kind: str = "double") -> Column:
    return strip(F.col(name)).try_cast(kind)


def clean_stops(raw: DataFrame, line: str = LINE) -> DataFrame:
    """Trimmed ids, no blank id, both coordinates 0.0 when either is unusable; the last row of an id wins."""
    def coordinate(name: str) -> Column:
        blank = F.coalesce(F.col(name), F.lit("")) == ""
        return F.when(blank, 0.0).otherwise(_number(name))

    lat, lon = coordinate("stop_lat"), coordinate("stop_lon")
    usable = lat.isNotNull() & lon.isNotNull()
    rows = raw.select(
        strip(F.col("stop_id")).alias("stop_id"),
        F.coalesce(strip(F.col("stop_name")), F.lit("")).alias("stop_name"),
        F.when(usable, lat).otherwise(0.0).alias("stop_lat"),
        F.when(usable, lon).otherwise(0.0).alias("stop_lon"), line)
    return dedup_last(rows.filter("stop_id <> ''"), ["stop_id"], line).drop(line)


def read_stops(spark: SparkSession, path: str) -> DataFrame:
    return clean_stops(_csv(spark, path))


def read_shape_points(spark: SparkSession, path: str) -> DataFrame:
    """Shape points with `point_order`, the file order; rows without an id, number or position are skipped."""
    raw = _csv(spark, path)
    sequence = F.when(F.coalesce(F.col("shape_pt_sequence"), F.lit("")) == "", F.lit(0)).otherwise(
        _number("shape_pt_sequence", "int"))
    return raw.select(
        strip(F.col("shape_id")).alias("shape_id"), sequence.alias("shape_pt_sequence"),
        _number("shape_pt_lat").alias("shape_pt_lat"), _number("shape_pt_lon").alias("shape_pt_lon"),
        F.col(LINE).alias("point_order"),
    ).filter("shape_id <> '' AND shape_pt_sequence IS NOT NULL AND shape_pt_lat IS NOT NULL "
             "AND shape_pt_lon IS NOT NULL")


def read_gtfs_static(spark: SparkSession, folder: str, ext: str = "txt") -> dict[str, DataFrame]:
    """Shapes, trips (with `trip_order`, the file order) and routes (the last row per id) of an archive folder."""
    trips = _csv(spark, f"{folder}/trips.{ext}")
    routes = _csv(spark, f"{folder}/routes.{ext}")
    return {
        "shapes": read_shape_points(spark, f"{folder}/shapes.{ext}"),
        "trips": trips.select(strip(F.col("shape_id")).alias("shape_id"),
                              strip(F.col("route_id")).alias("route_id"), F.col(LINE).alias("trip_order"))
                      .filter("shape_id <> '' AND route_id <> ''"),
        "routes": dedup_last(
            routes.select(strip(F.col("route_id")).alias("route_id"),
                          F.coalesce(strip(F.col("route_color")), F.lit("")).alias("route_color"), LINE)
            .filter("route_id <> ''"), ["route_id"], LINE).drop(LINE),
    }
