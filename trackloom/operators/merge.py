"""Merging rerun results into a base track, by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.scalars import QUALITY_OK


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def ranked_candidates(candidates: DataFrame, frame: list[str], tie: list[str], keys=("confidence", "inliers", "good", "ratio")) -> DataFrame:
    """Candidates of each frame in order of preference, with their rank."""
    order = Window.partitionBy(*frame).orderBy(*[F.desc_nulls_last(k) for k in keys], *tie)
    return candidates.withColumn("rank", F.row_number().over(order))


def best_rerun(base: DataFrame, reruns: DataFrame, frame: str, score: str, accepted: str, order: str, copy: list[str], margin: float = 0.5) -> DataFrame:
    """Base rows, overwritten in `copy` by the frame's best rerun where that is accepted and the base is not, or it scores `margin` more.

    The base may hold a frame more than once; each row is judged. Equal reruns: the first by `order`.
    """
    first = Window.partitionBy(frame).orderBy(F.desc_nulls_last(score), order)
    best = reruns.filter(F.col(accepted)).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    best = best.select(F.col(frame), F.struct(*dict.fromkeys([*copy, score])).alias("_r"))
    joined = base.join(best, frame, "left")
    wins = F.col("_r").isNotNull() & (~F.coalesce(F.col(accepted), F.lit(False)) | (F.col(f"_r.{score}") >= F.col(score) + margin))
    joined = joined.withColumn("replaced", F.coalesce(wins, F.lit(False)))
    cols = [F.when(F.col("replaced"), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) if c in copy else F.col(c) for c in base.columns]
    return joined.select(*cols, "replaced")


def merge_plan(base: DataFrame, plan: DataFrame, candidates: DataFrame, frame: str, keep_seeds: bool = True) -> DataFrame:
    """The final path of a planned rerun: trusted seeds as they are, else the best gated candidate of the frame, else the expected point.

    candidates: gated rows (see joins.plan_gate) with confidence, plan_distance_m, latitude, longitude. Winner: highest confidence, then
    smallest distance, null last. plan: seed_trusted, expected_latitude, _longitude, _method, last row a frame by plan_order.
    """
    order = Window.partitionBy(frame).orderBy(F.desc_nulls_last("confidence"), F.asc_nulls_last("plan_distance_m"), "candidate_order")
    best = candidates.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(frame, F.struct("latitude", "longitude", "confidence", "plan_distance_m").alias("_c"))
    last = plan.groupBy(frame).agg(F.max_by(F.struct("seed_trusted", "expected_latitude", "expected_longitude", "expected_method"), F.col("plan_order")).alias("_p"))
    joined = base.join(last, frame, "left").join(best, frame, "left")
    seed = F.coalesce(F.col("_p.seed_trusted"), F.lit(False)) & F.lit(keep_seeds)
    local = F.col("_c").isNotNull()
    expected = F.col("_p.expected_latitude").isNotNull()
    pick = lambda s, l, e, none: F.when(seed, s).when(local, l).when(expected, e).otherwise(none)
    null = F.lit(None)
    out = {
        "final_latitude": pick(F.col("latitude"), F.col("_c.latitude"), F.col("_p.expected_latitude"), null),
        "final_longitude": pick(F.col("longitude"), F.col("_c.longitude"), F.col("_p.expected_longitude"), null),
        "final_accepted": pick(F.lit(True), F.lit(True), F.lit(False), F.lit(False)),
        "final_method": pick(F.lit("seed_keep"), F.lit("local_rerun"), F.concat(F.lit("path_expected_"), F.col("_p.expected_method")), F.lit("none")),
        "final_reason": pick(F.lit("seed_keep"), F.lit("accepted"), F.lit("stage10_no_local_path_match"), F.lit("no_expected_path")),
    }
    return joined.withColumns(out).drop("_p", "_c")


def first_passing(candidates: DataFrame, frame: list[str], reason: str, tie: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the best-ranked candidate of each frame with reason QUALITY_OK, diagnostics: all that were tried, up to and with that one)."""
    ranked = ranked_candidates(candidates, frame, tie)
    ok = F.min(F.when(F.col(reason) == QUALITY_OK, F.col("rank"))).over(Window.partitionBy(*frame))
    tried = ranked.withColumn("_ok", ok).filter(F.col("_ok").isNull() | (F.col("rank") <= F.col("_ok")))
    return tried.filter(F.col("rank") == F.col("_ok")).drop("_ok"), tried.drop("_ok")


def upgrade(base: DataFrame, candidates: DataFrame, frame: str, fallback: Column, reason: str, refine: Column, tie: list[str], least_cluster: int = 8, most_m: float = 140.0) -> DataFrame:
    """Give fallback rows of the base the first candidate that passes, refined, if its cluster and its distance to the row allow it.

    `refine` is a struct (latitude, longitude, cluster_inliers) over candidate columns: a plug-in's result, or the candidate as it is.
    """
    chosen, _ = first_passing(candidates.withColumn("_refined", refine), [frame], reason, tie)
    chosen = chosen.select(frame, F.col("_refined").alias("_r"))
    joined = base.join(chosen, frame, "left")
    d = haversine_m("latitude", "longitude", F.col("_r.latitude"), F.col("_r.longitude"))
    near = F.coalesce(d <= most_m, F.lit(True))
    status = F.when(~F.coalesce(fallback, F.lit(False)), "kept").when(F.col("_r").isNull(), "no_quality_candidate")
    status = status.when(F.coalesce(F.col("_r.cluster_inliers"), F.lit(0)) < least_cluster, "weak_cluster").when(~near, "too_far_from_path").otherwise("upgraded")
    joined = joined.withColumn("upgrade_status", status)
    win = F.col("upgrade_status") == "upgraded"
    cols = [F.when(win, F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) if c in ("latitude", "longitude") else F.col(c) for c in base.columns]
    return joined.select(*cols, "upgrade_status")


def overwrite_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns where a condition holds; rows and other columns stay."""
    ok = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(ok, v).otherwise(F.col(c)) if c in df.columns else F.when(ok, v) for c, v in values.items()})


def with_originals(df: DataFrame, columns: list[str], prefix: str = "original_") -> DataFrame:
    """Keep copies of columns under a prefix before they are overwritten."""
    return df.withColumns({f"{prefix}{c}": F.col(c) for c in columns if c in df.columns})
