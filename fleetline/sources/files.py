"""Decision files, raw payloads and route-line files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetline import schemas
from fleetline.functions.jsons import json_object


def read_decisions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One decision per line; blank and malformed lines are skipped."""
    return spark.read.schema(schemas.DECISIONS_JSONL).json(path, mode="DROPMALFORMED")


def _unframed(payload: Column) -> Column:
    """A payload without the five-byte registry header, when it has one."""
    framed = (F.octet_length(payload) > 5) & (F.hex(F.substring(payload, 1, 1)) == "00")
    return F.when(framed, F.substring(payload, F.lit(6), F.octet_length(payload))).otherwise(payload)


def _text(payload: Column) -> Column:
    return _unframed(payload).cast("string")


def decode_payload(df: DataFrame, schema: T.StructType, value: str = "value", key: str | None = "key") -> DataFrame:
    """Fields of JSON payloads; undecodable rows are dropped, fields of the key win over the value's."""
    out = df.withColumn("_v", json_object(_text(F.col(value)), schema)).filter("_v IS NOT NULL")
    if key is None or key not in df.columns:
        return out.select("_v.*")
    out = out.withColumn("_k", json_object(_text(F.col(key)), schema))
    return out.select(*[F.coalesce(f"_k.{c}", f"_v.{c}").alias(c) for c in schema.names])


def decode_avro_payload(df: DataFrame, avro_schema: str, value: str = "value") -> DataFrame:
    """Fields of Avro payloads; needs the Avro package on the class path."""
    from pyspark.sql.avro.functions import from_avro

    record = from_avro(_unframed(F.col(value)), avro_schema, {"mode": "PERMISSIVE"})
    return df.select(record.alias("_v")).filter("_v IS NOT NULL").select("_v.*")


def read_shapes(spark: SparkSession, glob: str) -> DataFrame:
    """Line features of all matching files; what is not JSON is skipped.

    A file holds one collection on each line, as `write_features` makes them, or one collection over many lines. Lines
    are read in parallel; only files without a line that is a collection are read whole, one task a file.
    """
    lines = spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.select("file", json_object(F.col("value"), schemas.SHAPE_FILE)["features"].alias("features"))
    unread = parsed.groupBy("file").agg(F.max(F.col("features").isNotNull()).alias("found")).filter("NOT found").collect()
    features = parsed.select(F.explode("features").alias("f"))
    if unread:
        reader = spark.read.schema(schemas.SHAPE_FILE).option("multiLine", True)
        whole = reader.json([r["file"] for r in unread], mode="DROPMALFORMED")
        features = features.unionByName(whole.select(F.explode("features").alias("f")))
    return features.select(
        "f.properties.route_id", "f.properties.route_short", "f.properties.mode", "f.properties.color",
        F.coalesce("f.properties.part", F.lit(0)).alias("part"),
        F.size("f.geometry.coordinates").cast("long").alias("n_points"),
        F.col("f.geometry.coordinates").alias("coordinates"))
