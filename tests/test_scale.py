"""Long keys, numbering without one task, cells of longitude, sources of several files: against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F
from trackloom.functions import scalars
from trackloom.functions.geo import haversine_m
from trackloom.operators import joins, windows
from trackloom.sources import frame_lists, kml, tables, telemetry


@pytest.mark.parametrize("long_key", [1 << 20, 50])
def test_nearest_in_time_by_slices_equals_plain_search(spark, monkeypatch, long_key):
    monkeypatch.setattr(joins, "LONG_KEY", long_key)
    rng = random.Random(4)
    left = [(i, rng.choice("ab"), rng.choice([None, float(rng.randrange(400)), rng.random() * 400])) for i in range(300)] + [(900, None, 3.0), (901, "c", 1.0)]
    right = [(i, rng.choice("ab"), rng.choice([float(rng.randrange(400)), rng.random() * 4000])) for i in range(200)] + [(902, None, 5.0), (903, "a", None)]
    a = spark.createDataFrame(left, "l long, k string, t double")
    b = spark.createDataFrame(right, "r long, k string, t double")
    got = {x.l: (x.r, x.time_gap) for x in joins.asof_nearest(a, b, "k", "t", "t", ["r"], "r").collect()}
    for i, k, t in left:
        near = [(abs(t - u), u, r) for r, q, u in right if q == k and u is not None] if t is not None else []
        best = min(near) if near else None
        assert got[i][0] == (best[2] if best else None), (i, k, t, got[i], best)


def test_a_long_key_is_linear(spark):
    n = 100_000
    left = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 2.0).alias("t"))
    right = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 2.0 + 0.5).alias("t"), F.col("id").alias("r"))
    out = joins.asof_nearest(left, right, "k", "t", "t", ["r"], "r")
    assert out.agg(F.sum("time_gap")).first()[0] == 0.5 * n
    path = spark.range(n).select(F.lit(1).alias("track"), F.col("id").alias("frame"), (F.col("id") * 1.0).alias("s"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), (F.col("id") % 1000 == 0).alias("ok"))
    filled = windows.fill_path(path, F.col("ok"), "track", ["frame"], "s")
    counts = {r.filtered_method: r["count"] for r in filled.groupBy("filtered_method").count().collect()}
    assert counts == {"raw_kept": 100, "interpolate_previous_next": n - 100 - 999, "hold_previous": 999}


@pytest.mark.parametrize("pieces", [256, 3])
def test_numbering_equals_one_sort(spark, monkeypatch, pieces):
    monkeypatch.setattr(windows, "PIECES", pieces)
    rng = random.Random(1)
    rows = [(rng.choice([None, rng.randrange(20), 7]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = {r.b: r.n for r in windows.number_rows(df, ["a", "b"], "n").collect()}
    assert got == {b: k for k, (_, b) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1)}
    text = df.withColumn("a", F.col("a").cast("string"))
    assert {r.b: r.n for r in windows.number_rows(text, ["a", "b"], "n").collect()} == {b: k for k, (_, b) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, str(r[0]), r[1])), 1)}
    assert windows.number_rows(df.limit(0), ["a"], "n").count() == 0


def test_pairs_of_a_track_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for track, (lat, lon) in enumerate([(0.0, 0.0), (60.0, 179.999), (-89.9995, 10.0), (32.0, 35.0)]):
        for i in range(60):
            rows.append((track, i, float(i), lat + rng.uniform(-0.004, 0.004), (lon + rng.uniform(-0.02, 0.02) + 180) % 360 - 180))
    df = spark.createDataFrame([r for r in rows if abs(r[3]) <= 90], "track int, frame int, query_time_s double, latitude double, longitude double")
    got = {(r.track, r.a, r.b) for r in joins.pairs_in_track(df, "track", "frame", 180.0, 1e9).collect()}
    every = df.alias("a").join(df.alias("b"), (F.col("a.track") == F.col("b.track")) & (F.col("a.frame") < F.col("b.frame")))
    want = every.filter(haversine_m(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude")) <= 180)
    assert got == {(r[0], r[1], r[2]) for r in want.select("a.track", "a.frame", "b.frame").collect()} and len(got) > 50


def test_telemetry_blocks(spark):
    text = "﻿1\r\n00:00:01,500 --> 00:00:02,000\r\n\r\n2\n00:00:02,000 --> 00:00:03,250\nSrtCnt : 7, DiffTime : 33ms\n2024-05-06 07:08:09.123\n[iso : 100] [shutter : 1/500.0 ] [latitude: 32.1] [longitude: -35.2] [rel_alt: 1.5 abs_alt: 20.25]\n\n3\n00:00:03,5 --> 00:00:04,000\nx\n\nx\n00:00:01,000 --> 00:00:02,000\n\n4\n0:00:01,000\n"
    rows = telemetry.parse_srt(spark.createDataFrame([(text,)], "value string")).orderBy("index").collect()
    assert [(r["index"], r.start_s, r.end_s) for r in rows] == [(1, 1.5, 2.0), (2, 2.0, 3.25)]
    a, b = rows
    assert a.raw_text == "" and a.latitude is None
    assert (b.srt_counter, b.diff_time_ms, b.timestamp_text, b.iso, b.shutter, b.latitude, b.longitude, b.rel_alt, b.abs_alt) == (7, 33, "2024-05-06 07:08:09.123", 100, "1/500.0", 32.1, -35.2, 1.5, 20.25)


def test_frame_lists_with_blanks(spark):
    lines = spark.createDataFrame([("1800, 4200 5400",), ("10-20:5\t7 # 99",), ("",)], "value string")
    assert [r.frame for r in frame_lists.sorted_frames(lines).collect()] == [7, 10, 15, 20, 1800, 4200, 5400]
    with pytest.raises(Exception, match="bad frame entry"):
        frame_lists.listed_frames(spark.createDataFrame([("1 2",)], "value string")).collect()


def test_files_with_other_headers_keep_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text('y,x,z\n3,4,"5\n6"\n')
    rows = sorted((r.x, r.y, r.z) for r in tables.read_table(spark, str(tmp_path)).collect())
    assert rows == [("1", "2", None), ("4", "3", "5\n6")]


def test_anchors_without_a_region_are_passed_over(spark):
    rows = [(0, True, 1), (1, True, None), (2, False, None), (3, True, None), (4, True, 1)]
    df = spark.createDataFrame([("t", *r) for r in rows], "track string, frame int, anchor boolean, region int")
    got = {r.frame: (r.context_reason, r.context_regions) for r in windows.context_regions(df, "anchor", "region", "track", ["frame"]).collect()}
    assert got[2] == ("between_same_grid_anchors", [1])
    assert {r.frame: r.consensus_region for r in windows.consensus_region(df, "anchor", "region", "track", ["frame"]).collect()}[2] == 1


def test_subset_layers_and_targets(spark):
    index = spark.createDataFrame([(i, f"f{i}") for i in range(6)], "ref_index long, flight_id string")
    got = tables.reference_subset(index, spark.createDataFrame([(4,), (1,), (4,)], "ref_index long")).orderBy("ref_index").collect()
    assert [(r.ref_index, r.source_ref_index, r.flight_id) for r in got] == [(0, 1, "f1"), (1, 4, "f4")]
    points = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.5, 2.5)], "t int, latitude double, longitude double")
    layers = kml.layers({"truth": points, "none": points.limit(0), "found": points.filter("t = 2")}, ["t"])
    text = kml.document(kml.placemarks(layers, "name", False), "name", "paths").first().value
    assert text.index("<name>truth</name>") < text.index("<name>found</name>") and "none" not in text
    labelled = spark.createDataFrame([(1, ""), (2, " Drone"), (3, "center")], "t int, prediction_target string")
    assert kml.prediction_target(labelled, ["t"]) == "drone" and kml.prediction_target(labelled.limit(1), ["t"]) == "unknown"


def test_distance_to_the_nearest_listed_region(spark):
    centers = F.expr("map(1, named_struct('latitude', 0.0D, 'longitude', 0.001D), 2, named_struct('latitude', 0.0D, 'longitude', 0.003D))")
    df = spark.createDataFrame([(1, 0.0, 0.0, [2, 1, 9]), (2, 0.0, 0.0, [9]), (3, None, 0.0, [1]), (4, 0.0, 0.0, [2])], "i int, lat double, lon double, ids array<int>")
    got = {r.i: r.d for r in df.select("i", scalars.nearest_listed_distance("lat", "lon", "ids", centers).alias("d")).collect()}
    metre = math.radians(0.001) * 6_371_000
    assert got[2] is None and got[3] is None and abs(got[1] - metre) < 1e-6 and abs(got[4] - 3 * metre) < 1e-6


def test_radii_are_counted_rung_by_rung(spark):
    from trackloom.operators import joins

    xy = [(i, float(i % 40 * 5), float(i // 40 * 5)) for i in range(800)]
    points = spark.createDataFrame([*xy, (900, None, 1.0)], "p long, east_m double, north_m double")
    targets = spark.createDataFrame([(0, 1, 100.0, 50.0), (1, 1, 101.0, 50.0), (2, 2, 0.0, 0.0), (3, 3, 900.0, 0.0), (4, 4, None, 0.0), (5, None, 50.0, 50.0)], "t long, g long, east_m double, north_m double")
    once, rungs = (sorted(map(str, joins.count_by_radius(points, targets, "g", "t", "p", [20.0, 30.0, 45.0], 30, by_rungs=x).collect())) for x in (False, True))
    assert rungs == once and "radius_m=30.0" in "".join(once) and "radius_m=20.0" in "".join(once)
