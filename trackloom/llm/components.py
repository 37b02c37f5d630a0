"""Connected components of a distributed edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut_lineage, drop_written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b) with a > b: every node is linked with its least neighbour (or itself), for its larger neighbours or its smaller ones."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = near.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and what tells them from others: their number and two sums of hashes, taken while writing."""
    seen = Observation()
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 30)), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64("b", "a") % (1 << 30)), F.lit(0)).alias("y")]
    out = cut_lineage(edges.observe(seen, *sums))
    return out, (seen.get["n"], seen.get["x"], seen.get["y"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), two long columns; a component is named by its least node.

    Self-loops, repeated and reversed edges and an empty table are fine. Each round is written to the shared folder.
    """
    current, state = _written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while state[0]:
        step, new = _written(_stars(_stars(current, True), False))
        drop_written(current.sparkSession, current)
        current = step
        if new == state:
            break
        state = new
    pairs = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
