"""Points in unions of discs: against all pairs, with ids of several places, without a group, and where pairs would be too many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from trackloom.operators import discs, joins


@pytest.mark.parametrize("held", [(1 << 18, 1 << 20), (30, 40)])
def test_covered_points_equal_all_pairs(monkeypatch, held):
    monkeypatch.setattr(discs, "_RUNS", held[0])
    monkeypatch.setattr(discs, "_MEASURED", held[1])
    rng = np.random.default_rng(1)
    for trial in range(30):
        n, m, radius = int(rng.integers(1, 400)), int(rng.integers(1, 120)), float(rng.choice([3.0, 20.0, 50.0]))
        if trial % 3 == 0:
            px, py, tx, ty = (rng.integers(0, 40, k) * 5.0 for k in (n, n, m, m))
        elif trial % 3 == 1:
            px, py, tx, ty = rng.uniform(-1e6, -1e6 + 200, n), rng.uniform(0, 200, n), rng.uniform(-1e6, -1e6 + 200, m), rng.uniform(-50, 250, m)
        else:
            px, py, tx, ty = np.full(n, 7.0), rng.uniform(0, 30, n), rng.uniform(0, 20, m), rng.uniform(0, 20, m)
        group = np.sort(rng.integers(0, 7, m)).astype(np.int64)
        near = np.sqrt((px[:, None] - tx) ** 2 + (py[:, None] - ty) ** 2) <= radius
        assert discs.covered(px, py, tx, ty, group, 7, radius).tolist() == [int(near[:, group == g].any(axis=1).sum()) for g in range(7)]


@pytest.mark.parametrize("rows", [1 << 19, 40])
@pytest.mark.parametrize("by_rungs", [False, True])
def test_counts_by_radius_equal_all_pairs(spark, monkeypatch, rows, by_rungs):
    monkeypatch.setattr(joins, "TILE_ROWS", rows)
    rng = random.Random(5)
    points = [(rng.choice([None, *range(260)]), rng.uniform(-90, 90), rng.uniform(-90, 90)) for _ in range(300)] + [(1000, None, 0.0), (1001, float("nan"), 0.0), (1002, float("inf"), 0.0)]
    points += points[:20]
    targets = [(i, rng.choice([None, ("a", 1), ("a", 2), ("b", None)]), rng.uniform(-90, 90), rng.uniform(-90, 90)) for i in range(9)] + [(90, ("c", 1), 900.0, 0.0), (91, ("d", 1), None, 0.0)]
    p = spark.createDataFrame(points, "p long, east_m double, north_m double")
    t = spark.createDataFrame(targets, "t long, g struct<a: string, b: int>, east_m double, north_m double")
    got = {r.g and tuple(r.g): (r.radius_m, r.reference_count) for r in joins.count_by_radius(p, t, "g", "t", "p", [10.0, 20.0, 30.0], 25, by_rungs).collect()}
    want = {}
    for g in {g for _, g, _, _ in targets}:
        for radius in (10.0, 20.0, 30.0):
            n = len({i for i, x, y in points if x is not None for _, h, u, v in targets if h == g and u is not None and ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= radius})
            if n >= 25:
                break
        want[g] = (radius, n)
    assert got == want


def test_dense_places_do_not_become_pairs(spark):
    xy = (F.rand(1) * 100).alias("east_m"), (F.rand(2) * 100).alias("north_m")
    points = spark.range(300_000).select(F.col("id").alias("p"), *xy)
    targets = spark.range(100_000).select(F.col("id").alias("t"), (F.col("id") % 10).alias("g"), *xy)
    got = joins.count_by_radius(points, targets, "g", "t", "p", [20.0, 30.0], 10, by_rungs=True).collect()
    assert sorted((r.g, r.radius_m, r.reference_count) for r in got) == [(g, 20.0, 300_000) for g in range(10)]
