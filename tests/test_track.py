"""The sequential operators and the examples that fix their meaning, with plain Python as the second opinion."""

import random

import pytest
from pyspark.sql import functions as F
from trackloom.functions import geo, scalars
from trackloom.operators import joins, merge, repair, retrieval, stats, track, windows
from trackloom.sources import frame_lists, kml, tables, telemetry

NEAR, FAR = (32.1000, 35.2000), (32.1100, 35.2100)


def path(spark, places, **more):
    rows = [(1, i, float(10 * i), *p, 20.0, 1 if p == NEAR else 2, True) for i, p in enumerate(places)]
    df = spark.createDataFrame(rows, "track int, frame long, query_time_s double, latitude double, longitude double, confidence double, cell_id int, path_accepted boolean")
    for k, v in more.items():
        df = df.withColumn(k, v)
    return df


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_geometry(spark):
    r = one(
        spark,
        east=geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)),
        ahead=geo.haversine_m(F.lit(32.0), F.lit(35.0), geo.camera_ground_point(32.0, 35.0, 90.0, 100.0, 45.0)["latitude"], geo.camera_ground_point(32.0, 35.0, 90.0, 100.0, 45.0)["longitude"]),
        centre=geo.pixel_offset_m(960, 540, 1920, 1080, 30, 80, 45, 70),
        null=geo.haversine_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)),
    )
    assert abs(r.east - 90) < 1e-9 and 99 < r.ahead < 101 and r.centre.east_m == r.centre.north_m == 0 and r.null is None
    with pytest.raises(Exception, match="camera angle"):
        one(spark, bad=geo.ground_distance_m(F.lit(10.0), F.lit(90.0)))


def test_timecode(spark):
    r = one(spark, a=scalars.timecode(F.lit(3661.2345)), b=scalars.timecode(F.lit(None).cast("double")), c=scalars.timecode(F.lit("x")), d=scalars.timecode(F.lit(-1.0)), e=scalars.timecode(F.lit(0.0025)))
    assert tuple(r) == ("01:01:01.234", "", "", "", "00:00:00.002")


def test_telemetry_text(spark):
    block = "1\n00:00:01,000 --> 00:00:01,033\nSrtCnt : 1, DiffTime : 33ms\n2024-01-01 10:00:00.000\n[iso : 100] [shutter : 1/500.0] [fnum : 280] [focal_len : 24.00] [latitude: 32.5] [longitude: 35.1] [rel_alt: 50.1 abs_alt: 300.2]"
    zero = "2\n00:00:02,000 --> 00:00:02,033\n[latitude: 0.0] [longitude: 0.0]"
    text = "\n\n".join([block, zero, "x\n00:00:03,000 --> 00:00:03,033\nbody", "lonely line"])
    rows = telemetry.parse_srt(spark.createDataFrame([(text,)], "value string")).orderBy("index")
    first, second = rows.collect()
    assert (first["index"], first.start_s, first.end_s, first.srt_counter, first.diff_time_ms) == (1, 1.0, 1.033, 1, 33)
    assert (first.latitude, first.longitude, first.rel_alt, first.abs_alt, first.iso, first.shutter, first.fnum, first.focal_len) == (32.5, 35.1, 50.1, 300.2, 100, "1/500.0", 280, 24.0)
    assert second.iso is None and telemetry.valid_telemetry(rows).count() == 1


def test_isolated_teleport_is_rejected_and_filled(spark):
    swept = repair.sweep_path(path(spark, [NEAR, FAR, NEAR]), "track", ["frame"])
    assert {r.frame: r.path_accepted for r in swept.collect()} == {0: True, 1: False, 2: True}
    full = windows.fill_path(swept, F.col("path_accepted"), "track", ["frame"], "query_time_s") if "query_time_s" in swept.columns else None
    joined = path(spark, [NEAR, FAR, NEAR]).drop("path_accepted").join(swept.select("frame", "path_accepted"), "frame")
    full = windows.fill_path(joined, F.col("path_accepted"), "track", ["frame"], "query_time_s")
    middle = full.filter("frame = 1").first()
    assert middle.filtered_method == "interpolate_previous_next" and abs(middle.filtered_latitude - NEAR[0]) < 1e-12


def test_supported_move_is_kept(spark):
    swept = repair.sweep_path(path(spark, [NEAR, FAR, FAR, FAR]), "track", ["frame"])
    assert all(r.path_accepted for r in swept.collect())


def test_seed_components(spark):
    places = [NEAR] * 4 + [FAR] * 2
    seeds = path(spark, places)
    kept = {r.frame: r.seed_trusted for r in repair.keep_dominant(seeds, "track", "frame").collect()}
    assert kept == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}
    few = {r.seed_trusted for r in repair.keep_dominant(path(spark, [NEAR, FAR]), "track", "frame").collect()}
    assert few == {True}
    supported = {r.frame: r.seed_trusted for r in repair.keep_supported(seeds, "track", "frame").collect()}
    assert supported == kept


def test_tail_rescue_is_one_sided(spark):
    tail = (32.1010, 35.2010)
    places = [FAR] * 2 + [NEAR] * 5 + [tail] * 2
    df = path(spark, places, initial_seed=F.lit(True), seed_trusted=F.col("frame").between(2, 6))
    got = {r.frame: r.tail_rescued for r in repair.rescue_tail(df, "track", ["frame"]).collect()}
    assert got == {**{i: False for i in range(7)}, 7: True, 8: True}


def candidate(lat, lon, inliers=15, ratio=0.5, reason="accepted", visual=5.0, flight="f"):
    return track.Candidate(lat, lon, flight, inliers, ratio, visual, reason)


def test_filter_steps():
    cfg = track.FilterConfig()
    state, row = track.step(None, [candidate(*NEAR)], 0.0, cfg)
    assert row["filter_accepted"] and state.accepted == 1
    held, row = track.step(state, [candidate(*FAR)], 1.0, cfg)
    assert row["filter_reason"] == "temporal_jump_rejected_held_last" and (row["filtered_latitude"], held.time_s) == (NEAR[0], 1.0)
    still, _ = track.step(state, [candidate(*FAR)], 1.0, track.FilterConfig(advance_on_hold=False))
    assert still.time_s == 0.0
    strong, row = track.step(state, [candidate(*FAR, inliers=30)], 1.0, cfg)
    assert row["filter_accepted"] and abs(strong.latitude - (0.65 * NEAR[0] + 0.35 * FAR[0])) < 1e-12
    # the best by score is judged, an acceptable second one is not used; of equals the first counts
    _, row = track.step(None, [candidate(*FAR, visual=9.0, reason="weak_inlier_ratio"), candidate(*NEAR)], 0.0, cfg)
    assert not row["filter_accepted"] and row["filter_reason"] == "weak_inlier_ratio"
    assert track.choose([candidate(*NEAR), candidate(*FAR)], None, 0.0, cfg).candidate.latitude == NEAR[0]
    assert track.step(state, [], 2.0, cfg)[1]["filter_reason"] == "missing_prediction"


def test_batch_filter_equals_the_steps(spark):
    rng = random.Random(1)
    rows = [(t, f, k, float(f), 32.1 + rng.random() * 0.004, 35.2 + rng.random() * 0.004, "f", rng.randrange(40), rng.random(), rng.random() * 8, rng.choice(["accepted", "accepted", "weak_inlier_ratio"])) for t in range(4) for f in range(60) for k in range(rng.randrange(3))]
    df = spark.createDataFrame(rows, "track long, frame long, k long, query_time_s double, latitude double, longitude double, matched_flight string, inliers long, ratio double, visual_score double, gate_reason string")
    got = {(r.track, r.frame): (r.filtered_latitude, r.filter_reason) for r in track.filter_tracks(df.repartition(5), "track", "frame", "k").collect()}
    for t in range(4):
        state = None
        for f in range(60):
            found = [candidate(r[4], r[5], r[7], r[8], r[10], r[9]) for r in rows if r[0] == t and r[1] == f]
            if found:
                state, row = track.step(state, found, float(f), track.FilterConfig())
                assert got[t, f] == (row["filtered_latitude"], row["filter_reason"])


def test_nearest_in_time_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 5.0), (2, 1.0), (1, None)], "k int, t double")
    right = spark.createDataFrame([(1, 8.0, "a"), (1, 12.0, "b"), (1, 8.0, "c"), (1, None, "d")], "k int, t double, v string")
    got = {(r.k, r.t): r.v for r in joins.asof_nearest(left, right, "k", "t", "t", ["v"], "v").collect()}
    assert got == {(1, 10.0): "a", (1, 5.0): "a", (2, 1.0): None, (1, None): None}


def test_radius_join_equals_all_pairs(spark):
    rng = random.Random(9)
    a = [(i, rng.uniform(-100, 100), rng.uniform(-100, 100)) for i in range(200)]
    b = [(i, rng.uniform(-100, 100), rng.uniform(-100, 100)) for i in range(50)]
    p = spark.createDataFrame(a, "p long, east_m double, north_m double")
    t = spark.createDataFrame(b, "t long, east_m double, north_m double")
    got = {(r.p, r.t) for r in joins.within_radius(p, t, 15.0, "t").collect()}
    assert got == {(i, j) for i, x, y in a for j, u, v in b if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 15}


def test_ladders():
    assert joins.radius_ladder(120, 260) == [120, 180, 260]
    assert joins.radius_ladder(180, 500, clamp=False) == [180, 270, 405, 607.5]


def test_retrieval_blocks_equal_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, None), (301, [0.0] * 8)]
    df = spark.createDataFrame(rows, "ref_index long, descriptor array<double>")
    q = df.filter("ref_index < 20").withColumnRenamed("ref_index", "query_id")
    one_way = sorted((r.query_id, r.rank, r.ref_index) for r in retrieval.cosine_topk(q, df, 4).collect())
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 0)
    monkeypatch.setattr(retrieval, "BLOCK", 64)
    assert sorted((r.query_id, r.rank, r.ref_index) for r in retrieval.cosine_topk(q, df, 4).collect()) == one_way
    with pytest.raises(ValueError):
        retrieval.cosine_topk(q, df, 0)


def test_merge_keeps_seeds_and_falls_back(spark):
    base = spark.createDataFrame([(1, *NEAR), (2, *NEAR), (3, *NEAR)], "frame long, latitude double, longitude double")
    plan = spark.createDataFrame([(1, True, *NEAR, "seed_anchor", 1), (2, False, *NEAR, "hold_previous_seed", 2), (3, False, *NEAR, "hold_previous_seed", 3)], "frame long, seed_trusted boolean, expected_latitude double, expected_longitude double, expected_method string, plan_order long")
    found = spark.createDataFrame([(1, 9.0, 0.0, *FAR, 1), (2, 7.0, 50.0, *FAR, 1), (2, 7.0, 0.0, 32.2, 35.3, 2)], "frame long, confidence double, plan_distance_m double, latitude double, longitude double, candidate_order long")
    got = {r.frame: (r.final_latitude, r.final_accepted, r.final_method) for r in merge.merge_plan(base, plan, found, "frame").collect()}
    assert got == {1: (NEAR[0], True, "seed_keep"), 2: (32.2, True, "local_rerun"), 3: (NEAR[0], False, "path_expected_hold_previous_seed")}


def test_frame_lists_and_tables(spark, tmp_path):
    lines = spark.createDataFrame([("1800-1802:2, 7",), ("# nothing",), ("5 # five",), ("7",)], "value string")
    assert [r.frame for r in frame_lists.sorted_frames(lines).collect()] == [5, 7, 1800, 1802]
    with pytest.raises(Exception, match="bad frame entry"):
        frame_lists.sorted_frames(spark.createDataFrame([("9-3",)], "value string")).collect()
    csv = tmp_path / "path_window_012.csv"
    csv.write_text("a,,a,b\n1,2,3\n4,5,6,7\n")
    df = tables.read_table(spark, str(csv), keep_file=True)
    assert df.columns == ["a", "unnamed", "a__dup1", "b", "_file"]
    assert [tuple(r) for r in df.select("a", "b", tables.id_from_file("_file").alias("w")).collect()] == [("1", "", 12), ("4", "7", 12)]
    frame_lists.write_frame_list(spark.createDataFrame([(3,), (1,), (3,)], "f long"), "f", str(tmp_path / "frames"))
    assert [r.value for r in spark.read.text(str(tmp_path / "frames")).collect()] == ["1", "3"]


def test_kml(spark):
    points = spark.createDataFrame([("a<b", 2, 1.5, 2.5), ("a<b", 1, 1.0, 2.0), ("empty", 1, None, None)], "name string, t int, latitude double, longitude double")
    lines = kml.path_lines(points, "name", ["t"])
    assert lines.first().coordinates == "2.00000000,1.00000000,0.000 2.50000000,1.50000000,0.000"
    text = kml.document(kml.placemarks(lines, "name"), "name", "x & y").first().value
    assert "a&lt;b start" in text and "x &amp; y" in text and "empty" not in text


def test_error_summary_is_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)] + [(None,)], "e double")
    r = stats.summarize_errors(df, "e").first()
    assert (r.n, r.mean_m, r.median_m, r.p95_m) == (20, 10.5, 10.5, 19.0)
    assert stats.summarize_errors(df.filter("e < 0"), "e").first().p95_m is None


def test_stream_equals_batch(spark, tmp_path):
    from trackloom.streaming import track_stream

    rng = random.Random(7)
    rows = [(str(t), f, 0, float(f), 32.1 + rng.random() * 0.004, 35.2 + rng.random() * 0.004, "f", rng.randrange(40), rng.random(), rng.random() * 8, "accepted") for t in range(2) for f in range(30)]
    schema = "track string, frame long, k long, query_time_s double, latitude double, longitude double, matched_flight string, inliers long, ratio double, visual_score double, gate_reason string"
    df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.col("query_time_s") + 1_700_000_000))
    want = {(r.track, r.frame): (round(r.filtered_latitude, 9), r.filter_reason) for r in track.filter_tracks(df, "track", "frame", "k").collect()}
    end = spark.createDataFrame([("end", 0, 0, 1e6, 0.1, 0.1, "f", 1, 1.0, 1.0, "accepted")], schema).withColumn("at", F.timestamp_seconds(F.lit(1_800_000_000)))
    source = str(tmp_path / "in")
    df.filter("frame % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    df.filter("frame % 2 = 0").coalesce(1).write.mode("append").parquet(source)
    end.coalesce(1).write.mode("append").parquet(source)
    stream = track_stream.filter_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source), "track", "frame", "k", "at", "60 seconds")
    run = stream.writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(90)
    got = {(r.track, r.frame): (round(r.filtered_latitude, 9), r.filter_reason) for r in spark.sql("select * from filtered").collect() if r.track != "end"}
    assert got == want


def test_decimals_are_rounded_by_the_exact_value(spark):
    import random

    from pyspark.sql import functions as F
    from trackloom.sources import kml

    rng = random.Random(6)
    values = [float(f"{rng.choice(['', '-'])}{rng.choice([0, 1, 32, 179])}.{rng.randrange(10**8):08d}5") for _ in range(400)]
    values += [k / 512 for k in range(-40, 40)] + [k / 16 for k in range(9)] + [0.999999995, -0.999999995, 5e-9, 1.5e-8, 0.0, 32.1, 1e12 + 0.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", kml.fixed(F.col("v"), 8).alias("a"), kml.fixed(F.col("v"), 3).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [("%.8f" % r.v, "%.3f" % r.v) for r in rows]
