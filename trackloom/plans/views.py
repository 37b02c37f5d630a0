"""The driver's tables as track data: `events` as predictions of a track per user, `embeddings` as descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: track, frame, time and invented match figures that depend on event_id, value and type only."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    inliers = F.floor(F.col("value")).cast("long") % 60
    return e.select(
        F.col("user_id").alias("track"), F.col("event_id").alias("frame"), F.col("event_type"), (micros / 1e6).alias("query_time_s"),
        (F.lit(32.10) + F.lit(0.005) * F.sin(F.col("event_id") * F.lit(1.7))).alias("latitude"),
        (F.lit(35.20) + F.lit(0.005) * F.cos(F.col("event_id") * F.lit(2.3))).alias("longitude"),
        (F.col("event_type") != "error").alias("accepted"), inliers.alias("inliers"), (inliers * 2).alias("good"),
        ((inliers % 10) / 10.0).alias("ratio"), (F.col("event_id") % 100 / 100.0).alias("similarity"), ((F.col("event_id") % 7) / 20.0).alias("area"),
        ((F.col("event_id") % 11) / 20.0).alias("width"), ((F.col("event_id") % 13) / 20.0).alias("height"), (F.col("event_id") % 5 != 0).alias("inside"), (F.col("event_id") % 9 != 0).alias("geometry_ok"),
        F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("matched_flight"),
    )


#: The same in SQL, for the oracle.
PREDICTIONS_SQL = """p as (
  select user_id as track, event_id as frame, event_type, epoch_us(ts) / 1e6 as query_time_s,
    32.10e0 + 0.005e0 * sin(event_id * 1.7e0) as latitude, 35.20e0 + 0.005e0 * cos(event_id * 2.3e0) as longitude,
    event_type <> 'error' as accepted, cast(floor(value) as bigint) % 60 as inliers, (cast(floor(value) as bigint) % 60) * 2 as good,
    ((cast(floor(value) as bigint) % 60) % 10) / 10e0 as ratio, (event_id % 100) / 100e0 as similarity, (event_id % 7) / 20e0 as area,
    (event_id % 11) / 20e0 as width, (event_id % 13) / 20e0 as height, event_id % 5 <> 0 as inside, event_id % 9 <> 0 as geometry_ok,
    'f' || (event_id % 3) as matched_flight
  from events)"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (
        f"(power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    )
    return f"(2 * 6371000e0 * atan2(sqrt({h}), sqrt(greatest(0e0, 1 - {h}))))"
