"""Telemetry subtitles (SRT) and frame tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import file_stem, has_valid_gps, number_or_null

#: The fields of a telemetry block and the patterns they are written in.
FIELDS = {
    "srt_counter": (r"SrtCnt\s*:\s*(\d+)", "long"),
    "diff_time_ms": (r"DiffTime\s*:\s*(\d+)\s*ms", "long"),
    "latitude": (r"\[latitude:\s*(-?\d+(?:\.\d+)?)\]", "double"),
    "longitude": (r"\[longitude:\s*(-?\d+(?:\.\d+)?)\]", "double"),
    "rel_alt": (r"\[rel_alt:\s*(-?\d+(?:\.\d+)?)", "double"),
    "abs_alt": (r"abs_alt:\s*(-?\d+(?:\.\d+)?)\]", "double"),
    "focal_len": (r"\[focal_len\s*:\s*(-?\d+(?:\.\d+)?)\]", "double"),
    "iso": (r"\[iso\s*:\s*(\d+)\]", "int"),
    "shutter": (r"\[shutter\s*:\s*([^\]]+)\]", "string"),
    "fnum": (r"\[fnum\s*:\s*(\d+)\]", "int"),
}
TIMESTAMP = r"(\b\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+\b)"
CLOCK = r"(\d{2}):(\d{2}):(\d{2}),(\d{3})"
TIME_RANGE = CLOCK + r"\s*-->\s*" + CLOCK


def capture(text: Column, pattern: str, kind: str) -> Column:
    """The first capture, trimmed, as a value of the kind, null if there is none."""
    return F.nullif(stripped(F.regexp_extract(text, pattern, 1)), F.lit("")).try_cast(kind)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def time_range(text: Column) -> tuple[Column, Column]:
    """Start and end in seconds of the first HH:MM:SS,mmm --> HH:MM:SS,mmm in a text, null where there is none."""
    part = lambda i: F.regexp_extract(text, TIME_RANGE, i).try_cast("double")
    seconds = lambda i: part(i) * 3600 + part(i + 1) * 60 + part(i + 2) + part(i + 3) / 1000
    return seconds(1), seconds(5)


def parse_srt(texts: DataFrame, text_col: str = "value", flight: Column | None = None) -> DataFrame:
    """One row a well-formed block: a line with a whole number, a line with a time range, and a body, which may be empty. Others are left
    out. Lines are trimmed, blank ones skipped; a byte order mark is dropped."""
    flight = F.lit(None).cast("string") if flight is None else flight
    clean = F.regexp_replace(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), "^﻿", "")
    blocks = texts.select(flight.alias("flight_id"), F.posexplode(F.split(F.trim(clean), r"\n\s*\n")).alias("block", "raw"))
    lines = blocks.withColumn("lines", F.filter(F.transform(F.split("raw", "\n"), stripped), lambda x: x != ""))
    body = F.array_join(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0))), "\n")
    start, end = time_range(F.get("lines", F.lit(1)))
    number = F.regexp_extract(F.get("lines", F.lit(0)), r"^([+-]?\d+)$", 1).try_cast("long")
    rows = lines.select("flight_id", "block", number.alias("index"), start.alias("start_s"), end.alias("end_s"), body.alias("raw_text"))
    rows = rows.filter("index is not null and start_s is not null and end_s is not null")
    text = F.col("raw_text")
    return rows.select("flight_id", "index", "start_s", "end_s", capture(text, TIMESTAMP, "string").alias("timestamp_text"), *[capture(text, p, k).alias(n) for n, (p, k) in FIELDS.items()], "raw_text")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry of one or many files; the flight is named by the file."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    return parse_srt(texts, "value", file_stem("_path"))


def valid_telemetry(telemetry: DataFrame) -> DataFrame:
    return telemetry.filter(has_valid_gps("latitude", "longitude"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Typed frame metadata from CSV; rows without coordinates or picture, or at (0, 0), go. A missing flight is the file's name."""
    from .tables import read_table

    raw = read_table(spark, path, keep_file=True)
    text = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    number = lambda c: number_or_null(text(c))
    rows = raw.select(
        F.coalesce(F.nullif(F.trim(text("flight_id")), F.lit("")), file_stem("_file")).alias("flight_id"),
        number("frame_index").cast("long").alias("frame_index"), number("video_time_s").alias("video_time_s"), F.trim(text("image_path")).alias("image_path"),
        number("telemetry_index").cast("long").alias("telemetry_index"), number("telemetry_time_s").alias("telemetry_time_s"), number("time_error_s").alias("time_error_s"),
        *[number(c).alias(c) for c in ("latitude", "longitude", "rel_alt", "abs_alt")],
    )
    return rows.filter(has_valid_gps("latitude", "longitude") & (F.coalesce(F.col("image_path"), F.lit("")) != ""))
