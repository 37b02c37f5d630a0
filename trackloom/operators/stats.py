"""Summaries of tracks and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from .windows import jumps


def summarize_errors(df: DataFrame, error: str, group: list[str] = ()) -> DataFrame:
    """count, mean, rmse, median and nearest-rank 95th percentile; nulls are left out, no rows give nulls."""
    e = F.col(error)
    return df.groupBy(*group).agg(
        F.count(e).alias("n"), F.avg(e).alias("mean_m"), F.sqrt(F.avg(e * e)).alias("rmse_m"), F.median(e).alias("median_m"),
        F.expr(f"percentile_disc(0.95) within group (order by `{error}`)").alias("p95_m"),
    )


def distance_errors(predicted: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Distance of each predicted point from the true one with the same key; rows without a partner have a null error."""
    t = truth.select(*key, F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    return predicted.join(t, key, "full").withColumn("error_m", haversine_m("latitude", "longitude", "_lat", "_lon")).drop("_lat", "_lon")


def jump_stats(df: DataFrame, track: str, order: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Per track: placed rows, and count, mean, median, maximum of the jumps between them, and how many pass 100 and 200 m."""
    j = F.col("jump_m")
    return jumps(df, track, order, lat, lon).groupBy(track).agg(
        F.count(F.lit(1)).alias("points"), F.count(j).alias("jumps"), F.avg(j).alias("mean_jump_m"), F.median(j).alias("median_jump_m"),
        F.max(j).alias("max_jump_m"), F.count_if(j > 100).alias("jumps_over_100m"), F.count_if(j > 200).alias("jumps_over_200m"),
    )


def outcome_counts(df: DataFrame, track: str, accepted: Column, held: Column) -> DataFrame:
    """Per track: rows, and how many were accepted, held at the last place, or rejected."""
    a, h = F.coalesce(accepted, F.lit(False)), F.coalesce(held, F.lit(False))
    return df.groupBy(track).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(a).alias("accepted"), F.count_if(~a & h).alias("held"), F.count_if(~a & ~h).alias("rejected"))


def run_summary(df: DataFrame, track: str, order: list[str], accepted: Column, held: Column, medians: list[str]) -> DataFrame:
    """Per track: outcome counts and shares, jump statistics, and medians of the named columns."""
    counts = outcome_counts(df, track, accepted, held).withColumn("accepted_pct", 100 * F.col("accepted") / F.col("rows"))
    middle = df.groupBy(track).agg(*[F.median(c).alias(f"median_{c}") for c in medians])
    return counts.join(jump_stats(df, track, order), track, "left").join(middle, track)


def top_values(df: DataFrame, value: str, n: int, order: str, group: list[str] = ()) -> DataFrame:
    """The n most frequent values (of each group), ties by first appearance."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), "_first")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_first")


def value_counts(df: DataFrame, value: str, by_value: bool = False) -> DataFrame:
    """All values with their counts, by (count, value), or by value with the blank one last."""
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    blank = F.coalesce(F.col(value).cast("string"), F.lit("")) == ""
    return counted.orderBy(blank, value) if by_value else counted.orderBy(F.desc("n"), value)


def telemetry_profile(df: DataFrame, track: str, order: list[str], time: str, altitude: str) -> DataFrame:
    """Per track: rows, placed rows, time range, altitude range, first and last place, path length."""
    placed = jumps(df, track, order)
    first, last = Window.partitionBy(track).orderBy(*order), Window.partitionBy(track).orderBy(*[F.desc(c) for c in order])
    placed = placed.withColumns({"_first": F.row_number().over(first) == 1, "_last": F.row_number().over(last) == 1})
    at = lambda flag, c: F.max(F.when(F.col(flag), F.col(c)))
    paths = placed.groupBy(track).agg(
        F.count(F.lit(1)).alias("placed"), at("_first", "latitude").alias("first_latitude"), at("_first", "longitude").alias("first_longitude"),
        at("_last", "latitude").alias("last_latitude"), at("_last", "longitude").alias("last_longitude"), F.coalesce(F.sum("jump_m"), F.lit(0.0)).alias("path_m"),
    )
    rows = df.groupBy(track).agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("start_s"), F.max(time).alias("end_s"), F.min(altitude).alias("min_altitude"), F.max(altitude).alias("max_altitude"))
    return rows.join(paths, track, "left")


def anchors_per_cell(df: DataFrame, anchor: Column, cell: str, n: int | None = None) -> DataFrame:
    """Cells by number of anchors, most first, then by number."""
    counted = df.filter(anchor & F.col(cell).isNotNull()).groupBy(cell).agg(F.count(F.lit(1)).alias("anchor_count")).orderBy(F.desc("anchor_count"), cell)
    return counted.limit(n) if n is not None else counted


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet each condition."""
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])
