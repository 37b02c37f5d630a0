"""The repair plan: components by forests against plain search, folds over streamed tracks, few jobs."""

import random

import pytest
from pyspark.sql import functions as F
from trackloom.operators import joins, repair
from trackloom.plans import pipelines


@pytest.mark.parametrize("kept", [1 << 18, 3])
def test_components_of_tracks_equal_plain_search(spark, monkeypatch, kept):
    monkeypatch.setattr(repair, "_FOREST", kept)
    rng = random.Random(3)
    nodes = [(t, i) for t in range(3) for i in range(40)]
    edges = [(t, *(rng.randrange(40) for _ in "ab")) for t in range(3) for _ in range(25)]
    n = spark.createDataFrame([*nodes, (None, 1), (1, None), (0, 0)], "track int, frame long")
    got = sorted((r.track, r.frame, r.component) for r in repair.track_components(n, spark.createDataFrame(edges, "track int, a long, b long").repartition(5), "track", "frame").collect())
    low = {x: x[1] for x in nodes}
    for _ in nodes:
        for t, a, b in edges:
            low[t, a] = low[t, b] = min(low[t, a], low[t, b])
    assert got == sorted([(*x, low[x]) for x in nodes] + [(0, 0, low[0, 0])])


def test_folds_read_a_track_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(repair, "_SENT", 2)
    rows = [(t, i, None if i == 3 else float("nan") if i == 4 else float(i)) for t in (None, 1, 2) for i in range(6)]
    df = spark.createDataFrame(rows, "track int, frame int, v double")

    def work(rows):
        return [{**r, "place": str(k), "first": k == 0} for k, r in enumerate(rows)]

    got = repair._grouped(df.repartition(3), "track", ["v", "frame"], ["frame", "v"], "place string, first boolean", work).collect()
    order = [3, 4, 0, 1, 2, 5]
    assert sorted((r.track or 0, int(r.place), r.frame, r.first) for r in got) == sorted((t, k, i, k == 0) for t in (0, 1, 2) for k, i in enumerate(order))


def test_a_plan_takes_few_jobs_and_keeps_no_long_plan(spark):
    places = spark.range(400).select(
        (F.col("id") % 4).alias("track"), F.col("id").alias("frame"), (F.col("id") * 30.0).alias("query_time_s"), (32.1 + F.col("id") * 0.00002).alias("latitude"), F.lit(35.2).alias("longitude"),
        F.lit(True).alias("accepted"), F.lit(9.0).alias("confidence"), (F.col("id") % 3 == 0).alias("anchor"),
    )
    reference = spark.range(200).select(F.col("id").alias("ref_index"), (32.1 + F.col("id") * 0.00004).alias("latitude"), F.lit(35.2).alias("longitude"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    plan, stats = pipelines.repair_plan(places, reference, (32.1, 35.2))
    # before: rounds of components that went on until nothing changed, and a plan of all of them
    assert plan._jdf.queryExecution().analyzed().toString().count("parquet") == 2
    assert len(tracker.getJobIdsForGroup("plan")) <= 60
    assert plan.count() == 400 and stats.count() > 0


def test_windows_count_references_as_all_pairs_do(spark):
    rng = random.Random(7)
    frames = [(t, i, i * 20.0, 32.1 + rng.random() * 0.006, 35.2 + rng.random() * 0.006, True, 9.0, i % 5 == 0) for t in (None, 1, 2) for i in range(60)]
    frames = [(*r[:3], 32.1 + r[1] * 0.00005, 35.2, *r[5:]) if r[7] else r for r in frames]  # seeds fly straight on
    predictions = spark.createDataFrame(frames, "track int, frame long, query_time_s double, latitude double, longitude double, accepted boolean, confidence double, anchor boolean")
    refs = [(i % 280, 32.1 + rng.random() * 0.006, 35.2 + rng.random() * 0.006) for i in range(300)] + [(900, None, 35.2)]
    reference = spark.createDataFrame(refs, "ref_index long, latitude double, longitude double")
    plan, stats = pipelines.repair_plan(predictions, reference, (32.1, 35.2), pipelines.PlanConfig(frames=7))
    # before, the plan of the counts held that of every part several times, too long for the driver to write down
    assert len(stats._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    steps = [r for r in plan.filter("path_window_id is not null").select("track", "path_window_id", "east_m", "north_m").collect()]
    at = [(r.ref_index, r.east_m, r.north_m) for r in joins.with_local_xy(reference, (32.1, 35.2)).dropna().collect()]
    got = {(r.track, r.path_window_id): (r.local_radius_m, r.reference_count) for r in stats.collect()}
    assert len(got) > 10 and set(got) == {(r.track, r.path_window_id) for r in steps}
    for (track, window), found in got.items():
        own = [(r.east_m, r.north_m) for r in steps if (r.track, r.path_window_id) == (track, window)]
        for radius in (120.0, 180.0, 260.0):
            n = len({i for i, x, y in at for u, v in own if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= radius})
            if n >= 100:
                break
        assert found == (radius, n)
