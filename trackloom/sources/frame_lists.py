"""Lists of frame numbers as text: `a`, `a-b`, `a-b:step`, commas (and, in query lists, blanks) between, comments from # on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def expand_frames(lines: DataFrame, text_col: str = "value", order: str | None = None, blanks: bool = False) -> DataFrame:
    """(frame, pos): each frame of the list, the first place it appears at; malformed entries raise. `blanks`: blanks part entries too."""
    pos = F.col(order) if order else F.monotonically_increasing_id()
    text = F.regexp_replace(F.col(text_col), "#.*$", "")
    items = lines.select(pos.alias("_line"), F.posexplode(F.split(text, r"[,\s]" if blanks else ",")).alias("_at", "item"))
    items = items.withColumn("item", F.trim("item")).filter("item <> ''")
    part = lambda i: F.regexp_extract("item", r"^(\d+)(?:\s*-\s*(\d+)(?:\s*:\s*(\d+))?)?$", i)
    first = part(1).try_cast("long")
    last, step = F.coalesce(part(2).try_cast("long"), first), F.coalesce(part(3).try_cast("long"), F.lit(1).cast("long"))
    bad = first.isNull() | (last < first) | (step < 1)
    frames = F.when(bad, F.raise_error(F.concat(F.lit("bad frame entry: "), "item")).cast("array<bigint>")).otherwise(F.sequence(first, last, step))
    rows = items.select("_line", "_at", F.posexplode(frames).alias("_k", "frame"))
    return rows.groupBy("frame").agg(F.min(F.struct("_line", "_at", "_k")).alias("pos"))


def sorted_frames(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Distinct frames of a query list in ascending order."""
    return expand_frames(lines, text_col, blanks=True).select("frame").orderBy("frame")


def listed_frames(lines: DataFrame, text_col: str = "value", order: str | None = None) -> DataFrame:
    """Distinct frames in the order of the list."""
    return expand_frames(lines, text_col, order).orderBy("pos").select("frame")


def read_frame_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct frames of a query list in ascending order; a list without any raises."""
    frames = sorted_frames(spark.read.text(path))
    if frames.isEmpty():
        raise ValueError(f"no frames in {path}")
    return frames


def write_frame_list(df: DataFrame, frame: str, path: str) -> None:
    """Sorted distinct frames, one a line, in one file (a list of frames is small)."""
    frames = df.select(F.col(frame).cast("long").alias("f")).dropna().distinct()
    frames.orderBy("f").select(F.col("f").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)
