"""One registered query an operator of the track engine, over the whole driver tables, and the SQL to check it against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, scalars
from ..operators import joins, merge, repair, retrieval, stats, track, windows
from ..sources import frame_lists, kml
from . import pipelines
from .views import PREDICTIONS_SQL, haversine_sql, predictions, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
ORIGIN = (32.10, 35.20)
TRACK_ORDER = ["query_time_s", "frame"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _r(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def confidence() -> F.Column:
    return scalars.row_confidence("accepted", "good", "inliers", "ratio", "similarity", "inside", "geometry_ok", "area", "width", "height", F.lit(""))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    anchor = scalars.is_anchor("accepted", "latitude", "longitude", "confidence", "inliers", "good", "area", "width", "height")
    return p.withColumn("confidence", confidence()).withColumn("anchor", anchor)


_CONFIDENCE = """(case when accepted then 4e0 else -1.5e0 end + least(good, 80) / 12e0 + least(inliers, 60) / 6e0 + 5 * greatest(0e0, least(1e0, ratio)) + 2 * similarity
  + case when inside then 0.8e0 else -1.5e0 end + case when geometry_ok then 0.8e0 else -1.5e0 end
  - 8 * greatest(0e0, area - 0.08e0) - 4 * greatest(0e0, width - 0.35e0) - 4 * greatest(0e0, height - 0.35e0))"""
SCORED_SQL = (
    PREDICTIONS_SQL
    + f""", c as (select *, {_CONFIDENCE} as confidence from p),
s as (select *, accepted and confidence >= 6 and inliers >= 10 and good >= 20 and area <= 0.12e0 and width <= 0.45e0 and height <= 0.45e0 as anchor from c)"""
)
_XY_SQL = """radians(longitude - 35.20e0) * 6371000e0 * cos(radians((latitude + 32.10e0) / 2)) as east_m, radians(latitude - 32.10e0) * 6371000e0 as north_m"""
CELL_SQL = f"""xy as (select *, {_XY_SQL} from s),
b as (select min(east_m) - 30 as x0, max(east_m) + 30 as x1, min(north_m) - 30 as y0, max(north_m) + 30 as y1 from xy),
cells as (
  select (k + 1)::int as cell_id, (k // 5)::int as r, (k % 5)::int as q, x0 + (k % 5) * ((x1 - x0) / 5) as x_min_m, x0 + (k % 5 + 1) * ((x1 - x0) / 5) as x_max_m,
    y0 + (k // 5) * ((y1 - y0) / 3) as y_min_m, y0 + (k // 5 + 1) * ((y1 - y0) / 3) as y_max_m
  from b, range(15) as g(k))"""


def placed_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = joins.with_local_xy(scored(spark, sf_dir), ORIGIN)
    return p, joins.grid_cells(p.select("latitude", "longitude"), ORIGIN)


# -- statistics and errors -----------------------------------------------------------------------------------------------


@query(
    "track_jump_stats",
    f"""with {PREDICTIONS_SQL}, j as (
  select track, {haversine_sql("lag(latitude) over w", "lag(longitude) over w", "latitude", "longitude")} as d from p window w as (partition by track order by query_time_s, frame))
select track, count(*) as points, count(d) as jumps, round(avg(d), 3) as mean_jump_m, round(median(d), 3) as median_jump_m, round(max(d), 3) as max_jump_m,
  count(*) filter (d > 100) as jumps_over_100m, count(*) filter (d > 200) as jumps_over_200m
from j group by track""",
)
def track_jump_stats(spark, sf_dir):
    return _r(stats.jump_stats(predictions(spark, sf_dir), "track", TRACK_ORDER), {"mean_jump_m": 3, "median_jump_m": 3, "max_jump_m": 3})


@query(
    "error_summary",
    f"""with {PREDICTIONS_SQL}, e as (select track, {haversine_sql("latitude", "longitude", "32.10e0", "35.20e0")} as d from p)
select track, count(d) as n, round(avg(d), 3) as mean_m, round(sqrt(avg(d * d)), 3) as rmse_m, round(median(d), 3) as median_m, round(quantile_disc(d, 0.95), 3) as p95_m from e group by track""",
)
def error_summary(spark, sf_dir):
    truth = predictions(spark, sf_dir).select("frame", F.lit(ORIGIN[0]).alias("latitude"), F.lit(ORIGIN[1]).alias("longitude"))
    errors = stats.distance_errors(predictions(spark, sf_dir).select("frame", "track", "latitude", "longitude"), truth, ["frame"])
    return _r(stats.summarize_errors(errors, "error_m", ["track"]), {"mean_m": 3, "rmse_m": 3, "median_m": 3, "p95_m": 3})


@query(
    "run_summary",
    f"""with {PREDICTIONS_SQL}, j as (
  select *, {haversine_sql("lag(latitude) over w", "lag(longitude) over w", "latitude", "longitude")} as d from p window w as (partition by track order by query_time_s, frame))
select track, count(*) as rows, count(*) filter (accepted) as accepted, count(*) filter (not accepted and inliers >= 30) as held, count(*) filter (not accepted and inliers < 30) as rejected,
  round(100 * count(*) filter (accepted) / count(*), 6) as accepted_pct, count(d) as jumps, round(max(d), 3) as max_jump_m, median(inliers) as median_inliers
from j group by track""",
)
def run_summary(spark, sf_dir):
    s = stats.run_summary(predictions(spark, sf_dir), "track", TRACK_ORDER, F.col("accepted"), F.col("inliers") >= 30, ["inliers"])
    return _r(s, {"accepted_pct": 6, "max_jump_m": 3}).select("track", "rows", "accepted", "held", "rejected", "accepted_pct", "jumps", "max_jump_m", "median_inliers")


@query(
    "telemetry_profile",
    f"""with {PREDICTIONS_SQL}, j as (
  select *, {haversine_sql("lag(latitude) over w", "lag(longitude) over w", "latitude", "longitude")} as d from p window w as (partition by track order by query_time_s, frame))
select track, count(*) as rows, round(min(query_time_s), 3) as start_s, round(max(query_time_s), 3) as end_s, min(inliers) as min_altitude, max(inliers) as max_altitude, count(*) as placed,
  round(arg_min(latitude, (query_time_s, frame)), 8) as first_latitude, round(arg_min(longitude, (query_time_s, frame)), 8) as first_longitude,
  round(arg_max(latitude, (query_time_s, frame)), 8) as last_latitude, round(arg_max(longitude, (query_time_s, frame)), 8) as last_longitude, round(coalesce(sum(d), 0), 2) as path_m
from j group by track""",
)
def telemetry_profile(spark, sf_dir):
    s = stats.telemetry_profile(predictions(spark, sf_dir), "track", TRACK_ORDER, "query_time_s", "inliers")
    return _r(s, {"start_s": 3, "end_s": 3, "first_latitude": 8, "first_longitude": 8, "last_latitude": 8, "last_longitude": 8, "path_m": 2})


@query("reason_counts", "select event_type, count(*) as n from events group by event_type")
def reason_counts(spark, sf_dir):
    return stats.value_counts(table(spark, sf_dir, "events"), "event_type")


@query(
    "top_values",
    """with g as (select user_id as track, event_type, count(*) as n, min(event_id) as f from events group by all)
select track, event_type, n, rank::int as rank from (select *, row_number() over (partition by track order by n desc, f) as rank from g) where rank <= 3""",
)
def top_values(spark, sf_dir):
    return stats.top_values(predictions(spark, sf_dir), "event_type", 3, "frame", ["track"])


@query(
    "conditional_counts",
    f"""with {SCORED_SQL} select count(*) filter (accepted) as accepted, count(*) filter (anchor) as anchors, count(*) filter (not accepted and inliers < 10) as weak, count(*) filter (latitude > 32.10e0) as north from s""",
)
def conditional_counts(spark, sf_dir):
    p = scored(spark, sf_dir)
    return stats.conditional_counts(p, {"accepted": F.col("accepted"), "anchors": F.col("anchor"), "weak": ~F.col("accepted") & (F.col("inliers") < 10), "north": F.col("latitude") > 32.10})


# -- retrieval -----------------------------------------------------------------------------------------------------------


@query(
    "cosine_topk",
    """select query_id, ref_index, round(similarity, 6) as similarity, rank::int as rank from (
  select a.vec_id as query_id, b.vec_id as ref_index, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity,
    row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) as rank
  from embeddings a, embeddings b where a.vec_id % 25 = 0) where rank <= 10""",
)
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_index"), F.col("embedding").alias("descriptor"))
    q = e.filter("ref_index % 25 = 0").withColumnRenamed("ref_index", "query_id")
    return _r(retrieval.cosine_topk(q, e, 10), {"similarity": 6}).drop("distance")


@query(
    "multiscale_topk",
    """with q as (
  select vec_id as query_id, k.s as query_scale, case when k.s = 1 then embedding::double[] else list_transform(embedding::double[], lambda x, i: case when i <= 48 then x else 0e0 end) end as v
  from embeddings, (values (1e0), (0.75e0)) as k(s) where vec_id % 25 = 0),
h as (select query_id, query_scale, vec_id as ref_index, list_cosine_similarity(v, embedding::double[]) as similarity from q, embeddings),
t as (select *, row_number() over (partition by query_id, query_scale order by similarity desc, ref_index) as n from h),
b as (select *, row_number() over (partition by query_id, ref_index order by similarity desc, query_scale desc) as m from t where n <= 5),
r as (select *, row_number() over (partition by query_id order by similarity desc, ref_index) as rank from b where m = 1)
select query_id, query_scale, ref_index, round(similarity, 6) as similarity, rank::int as rank from r where rank <= 5""",
)
def multiscale_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_index"), F.col("embedding").cast("array<double>").alias("descriptor"))
    scale = F.explode(F.array(F.lit(1.0), F.lit(0.75))).alias("query_scale")
    q = e.filter("ref_index % 25 = 0").select(F.col("ref_index").alias("query_id"), scale, "descriptor")
    part = F.transform("descriptor", lambda x, i: F.when(i < 48, x).otherwise(0.0))
    q = q.withColumn("descriptor", F.when(F.col("query_scale") == 1.0, F.col("descriptor")).otherwise(part))
    return _r(retrieval.multiscale_topk(q, e, 5), {"similarity": 6}).drop("distance")


# -- headings and geometry -----------------------------------------------------------------------------------------------


def _bearing_sql(a: str, b: str, c: str, d: str) -> str:
    x = f"degrees(atan2(sin(radians(({d}) - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b})))))"
    return f"(({x} + 360) - 360 * floor(({x} + 360) / 360))"


_HEADINGS_SQL = f"""{PREDICTIONS_SQL}, n as (
  select *, lead(latitude) over w as nla, lead(longitude) over w as nlo, lag(latitude) over w as pla, lag(longitude) over w as plo from p window w as (partition by track order by query_time_s, frame)),
o as (select *, case when {haversine_sql("latitude", "longitude", "nla", "nlo")} > 0.25 then {_bearing_sql("latitude", "longitude", "nla", "nlo")}
  when {haversine_sql("pla", "plo", "latitude", "longitude")} > 0.25 then {_bearing_sql("pla", "plo", "latitude", "longitude")} end as own from n),
h as (select *, coalesce(own, last_value(own ignore nulls) over (partition by track order by query_time_s, frame rows between unbounded preceding and 1 preceding), 0e0) as heading_deg from o)"""


@query("headings", f"with {_HEADINGS_SQL} select frame, track, round(heading_deg, 6) as heading_deg from h")
def headings(spark, sf_dir):
    return _r(windows.headings(predictions(spark, sf_dir), "track", TRACK_ORDER), {"heading_deg": 6}).select("frame", "track", "heading_deg")


@query(
    "camera_center",
    f"""with {_HEADINGS_SQL}, g as (
  select frame, latitude, longitude, heading_deg, coalesce(nullif(inliers, 0), 80) / tan(radians(45e0)) / 6371000e0 as a from h),
d as (select frame, longitude, radians(latitude) as f, radians(heading_deg) as t, a, sin(radians(latitude)) * cos(a) + cos(radians(latitude)) * sin(a) * cos(radians(heading_deg)) as s from g)
select frame, round(degrees(asin(greatest(-1e0, least(1e0, s)))), 8) as center_lat,
  round(longitude + degrees(atan2(sin(t) * sin(a) * cos(f), cos(a) - sin(f) * s)), 8) as center_lon, round(a * 6371000e0, 4) as center_offset_m from d""",
)
def camera_center(spark, sf_dir):
    h = windows.headings(predictions(spark, sf_dir), "track", TRACK_ORDER)
    altitude = F.coalesce(F.nullif(F.col("inliers"), F.lit(0)), F.lit(80)).cast("double")
    h = h.withColumn("_p", geo.camera_ground_point("latitude", "longitude", "heading_deg", altitude, 45.0))
    h = h.withColumn("center_offset_m", geo.ground_distance_m(altitude, 45.0))
    return _r(h.select("frame", F.col("_p.latitude").alias("center_lat"), F.col("_p.longitude").alias("center_lon"), "center_offset_m"), {"center_lat": 8, "center_lon": 8, "center_offset_m": 4})


@query(
    "local_plane",
    f"""with {SCORED_SQL}, xy as (select frame, {_XY_SQL} from s), k as (select *, 32.10e0 + degrees((north_m + 10) / 6371000e0) as la from xy)
select frame, round(east_m, 4) as east_m, round(north_m, 4) as north_m, round(la, 8) as back_latitude, round(35.20e0 + degrees(east_m / (6371000e0 * cos(radians((la + 32.10e0) / 2)))), 8) as back_longitude from k""",
)
def local_plane(spark, sf_dir):
    p = joins.with_local_xy(predictions(spark, sf_dir), ORIGIN).withColumn("_b", geo.from_local_xy("east_m", F.col("north_m") + 10, *ORIGIN))
    return _r(p.select("frame", "east_m", "north_m", F.col("_b.latitude").alias("back_latitude"), F.col("_b.longitude").alias("back_longitude")), {"east_m": 4, "north_m": 4, "back_latitude": 8, "back_longitude": 8})


@query(
    "pixel_offset",
    f"""with {_HEADINGS_SQL}, f as (select frame, radians(heading_deg) as t, 2 * (80e0 / sin(radians(45e0))) * tan(radians(70e0) / 2) as a, (frame % 1920) as x, (frame % 1080) as y from h),
m as (select frame, t, (x - 960) / 1920e0 * a as r, (y - 540) / 1080e0 * (a * 1080 / 1920e0) as u from f)
select frame, round(r * cos(t) + u * sin(t), 4) as east_m, round(u * cos(t) - r * sin(t), 4) as north_m from m""",
)
def pixel_offset(spark, sf_dir):
    h = windows.headings(predictions(spark, sf_dir), "track", TRACK_ORDER)
    o = geo.pixel_offset_m((F.col("frame") % 1920).cast("double"), (F.col("frame") % 1080).cast("double"), 1920, 1080, "heading_deg", 80, 45, 70)
    return _r(h.withColumn("_o", o).select("frame", F.col("_o.east_m").alias("east_m"), F.col("_o.north_m").alias("north_m")), {"east_m": 4, "north_m": 4})


@query(
    "homography_check",
    f"""with {PREDICTIONS_SQL}, m as (select frame, 0.5e0 + (frame % 7) / 10e0 as a, (frame % 200) - 50e0 as e, (frame % 150) - 40e0 as f from p)
select frame, round(a * 960 + e, 4) as center_x, round(a * 540 + f, 4) as center_y, (a * 960 + e >= 0 and a * 960 + e < 1920 and a * 540 + f >= 0 and a * 540 + f < 1080) as center_inside,
  round(a * a * 1919 * 1079 / (1920 * 1080), 6) as quad_area_frac from m""",
)
def homography_check(spark, sf_dir):
    a, zero = F.lit(0.5) + (F.col("frame") % 7) / 10.0, F.lit(0.0)
    e, f = ((F.col("frame") % 200) - 50).cast("double"), ((F.col("frame") % 150) - 40).cast("double")
    h = F.array(a, zero, e, zero, a, f, zero, zero, F.lit(1.0))
    p = predictions(spark, sf_dir).withColumn("h", h).withColumn("g", geo.homography_diagnostics("h", 1920, 1080, 1920, 1080))
    return _r(p.select("frame", "g.center_x", "g.center_y", "g.center_inside", "g.quad_area_frac"), {"center_x": 4, "center_y": 4, "quad_area_frac": 6})


# -- joins ---------------------------------------------------------------------------------------------------------------


@query(
    "asof_nearest",
    f"""with {PREDICTIONS_SQL}, l as (select * from p where event_type = 'purchase'),
r as (select track, query_time_s as t, min(frame) as frame from p where event_type = 'view' group by all),
b as (select l.frame, l.track, l.query_time_s, r.frame as rf, r.t from l asof left join r on l.track = r.track and l.query_time_s >= r.t),
a as (select l.frame, r.frame as rf, r.t from l asof left join r on l.track = r.track and l.query_time_s <= r.t)
select b.frame, b.track, case when b.t is null or a.t - b.query_time_s < b.query_time_s - b.t then a.rf else b.rf end as view_frame,
  round(case when b.t is null or a.t - b.query_time_s < b.query_time_s - b.t then a.t - b.query_time_s else b.query_time_s - b.t end, 3) as time_gap
from b join a on a.frame = b.frame""",
)
def asof_nearest(spark, sf_dir):
    p = predictions(spark, sf_dir)
    left = p.filter("event_type = 'purchase'").select("frame", "track", "query_time_s")
    right = p.filter("event_type = 'view'").select("track", "query_time_s", F.col("frame").alias("view_frame"))
    out = joins.asof_nearest(left, right, "track", "query_time_s", "query_time_s", ["view_frame"], "view_frame")
    return _r(out.select("frame", "track", "view_frame", "time_gap"), {"time_gap": 3})


@query(
    "lookup_rewrite",
    """select o_orderkey, o_custkey, case when c_custkey is null then o_totalprice else c_acctbal end as o_totalprice, c_custkey is not null as matched
from orders left join (select * from customer where c_custkey % 3 <> 0) on o_custkey = c_custkey""",
)
def lookup_rewrite(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    dim = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_name")
    return joins.rewrite_from_lookup(orders, dim, ["o_custkey"], {"c_acctbal": "o_totalprice"}, "c_name")


@query(
    "three_key_lookup",
    """select l_orderkey, l_linenumber, coalesce(a.p_retailprice, b.p_retailprice) as p_retailprice from lineitem
left join (select p_partkey, p_size, p_retailprice from part where p_partkey % 2 = 0) a on l_partkey = a.p_partkey and l_linenumber = a.p_size
left join (select p_partkey, p_retailprice from part where p_partkey % 2 = 0) b on l_partkey = b.p_partkey""",
)
def three_key_lookup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("size"))
    dim = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size"), "p_retailprice", F.col("p_partkey").alias("o"))
    return joins.three_key_lookup(li, dim, [["part", "size"], ["part"]], "p_retailprice", "o").drop("part", "size")


@query(
    "nearest_center",
    f"""with {SCORED_SQL}, {CELL_SQL}, q as (select cell_id, 32.10e0 + degrees((y_min_m + y_max_m) / 2 / 6371000e0) as la, (x_min_m + x_max_m) / 2 as x from cells),
z as (select cell_id, la, 35.20e0 + degrees(x / (6371000e0 * cos(radians((la + 32.10e0) / 2)))) as lo from q),
d as (select frame, cell_id, {haversine_sql("latitude", "longitude", "la", "lo")} as d from s, z),
m as (select frame, arg_min(cell_id, (d, cell_id)) as id, min(d) as d from d group by frame)
select frame, case when d <= 100 then id end as center_id, round(case when d <= 100 then d end, 3) as center_distance_m from m""",
)
def nearest_center(spark, sf_dir):
    p, cells = placed_cells(spark, sf_dir)
    c = cells.withColumn("_p", geo.from_local_xy((F.col("x_min_m") + F.col("x_max_m")) / 2, (F.col("y_min_m") + F.col("y_max_m")) / 2, *ORIGIN))
    c = c.select("cell_id", F.col("_p.latitude").alias("latitude"), F.col("_p.longitude").alias("longitude"))
    return _r(joins.nearest_center(p, c, "cell_id", 100.0).select("frame", "center_id", "center_distance_m"), {"center_distance_m": 3})


@query(
    "grid_assign",
    f"""with {SCORED_SQL}, {CELL_SQL}
select frame, min(cell_id)::int as cell_id from xy left join cells on east_m between x_min_m - 1e-9 and x_max_m + 1e-9 and north_m between y_min_m - 1e-9 and y_max_m + 1e-9 group by frame""",
)
def grid_assign(spark, sf_dir):
    p, cells = placed_cells(spark, sf_dir)
    return joins.assign_cell(p.select("frame", "east_m", "north_m"), cells, "frame").select("frame", "cell_id")


@query(
    "grid_counts_halo",
    f"""with {SCORED_SQL}, {CELL_SQL}, n as (
  select cell_id, greatest(x_min_m - east_m, east_m - x_max_m, y_min_m - north_m, north_m - y_max_m, 0) as o from cells, xy),
k as (select cell_id, count(*) filter (o <= 1e-9) as base_count, count(*) filter (o <= 100) as h0, count(*) filter (o <= 150) as h1, count(*) filter (o <= 225) as h2, count(*) filter (o <= 260) as h3 from n group by cell_id)
select cell_id, base_count, case when h0 >= 900 then 100e0 when h1 >= 900 then 150e0 when h2 >= 900 then 225e0 else 260e0 end as halo_m,
  case when h0 >= 900 then h0 when h1 >= 900 then h1 when h2 >= 900 then h2 else h3 end as halo_count from k""",
)
def grid_counts_halo(spark, sf_dir):
    p, cells = placed_cells(spark, sf_dir)
    return joins.halo_counts(p.select("frame", "east_m", "north_m"), cells, joins.radius_ladder(100.0, 260.0), 900)


@query(
    "radius_ladder",
    f"""with {SCORED_SQL}, xy as (select *, {_XY_SQL} from s), t as (select track, frame as target, east_m as x, north_m as y from xy where event_type = 'signup'),
n as (select t.track, xy.frame, min(sqrt(power(east_m - x, 2) + power(north_m - y, 2))) as d from t, xy group by all),
k as (select track, count(*) filter (d <= 20) as h0, count(*) filter (d <= 30) as h1, count(*) filter (d <= 45) as h2, count(*) filter (d <= 60) as h3 from n group by track)
select track, case when h0 >= 20 then 20e0 when h1 >= 20 then 30e0 when h2 >= 20 then 45e0 else 60e0 end as radius_m,
  case when h0 >= 20 then h0 when h1 >= 20 then h1 when h2 >= 20 then h2 else h3 end as reference_count from k""",
)
def radius_ladder(spark, sf_dir):
    p = joins.with_local_xy(predictions(spark, sf_dir), ORIGIN)
    targets = p.filter("event_type = 'signup'").select("track", F.col("frame").alias("target"), "east_m", "north_m")
    return joins.count_by_radius(p, targets, "track", "target", "frame", joins.radius_ladder(20.0, 60.0), 20, by_rungs=True)


@query(
    "radius_semi_join",
    f"""with {SCORED_SQL}, xy as (select *, {_XY_SQL} from s)
select frame from xy a where exists (select 1 from xy b where b.event_type = 'error' and sqrt(power(a.east_m - b.east_m, 2) + power(a.north_m - b.north_m, 2)) <= 25)""",
)
def radius_semi_join(spark, sf_dir):
    p = joins.with_local_xy(predictions(spark, sf_dir), ORIGIN)
    targets = p.filter("event_type = 'error'").select(F.col("frame").alias("target"), "east_m", "north_m")
    return joins.near_any(p.select("frame", "east_m", "north_m"), targets, 25.0, "target", "frame").select("frame")


@query(
    "before_after_frames",
    f"""with {PREDICTIONS_SQL}, b as (select track, min(frame) as f from p where accepted group by track), a as (select track, min(frame) as g from p where inliers >= 20 group by track)
select track, f as before_frame, g as after_frame from b join a using (track)""",
)
def before_after_frames(spark, sf_dir):
    p = predictions(spark, sf_dir).select("track", "frame", "accepted", "inliers")
    joined = joins.before_after(p.filter("accepted"), p.filter("inliers >= 20"), "track", "frame")
    return joined.select("track", F.col("before.frame").alias("before_frame"), F.col("after.frame").alias("after_frame"))


@query(
    "hamming_ratio_match",
    """with d as (select vec_id, label, list_sum(list_transform(range(62), lambda i: case when embedding[i + 1] > 0 then (1::bigint << i::bigint) else 0 end))::bigint as bits from embeddings),
n as (select a.label as pair_id, a.vec_id as q_id, b.vec_id as r_id, bit_count(xor(a.bits, b.bits)) as d from d a join d b on a.label = b.label where a.vec_id % 10 = 0 and b.vec_id % 10 <> 0),
r as (select *, row_number() over (partition by pair_id, q_id order by d, r_id) as k from n),
w as (select pair_id, q_id, max(r_id) filter (k = 1) as r_id, max(d) filter (k = 1) as distance, max(d) filter (k = 2) as second from r where k <= 2 group by all)
select pair_id, q_id, r_id, distance::int as distance from w where distance < 0.8 * second""",
)
def hamming_ratio_match(spark, sf_dir):
    bits = F.aggregate(F.transform(F.slice("embedding", 1, 62), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long")), F.expr("0L"), lambda a, x: a + x)
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("pair_id"), "vec_id", bits.alias("bits"))
    q = e.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "q_id")
    r = e.filter("vec_id % 10 <> 0").withColumnRenamed("vec_id", "r_id")
    return joins.hamming_ratio_matches(q, r, 0.8)


# -- scores, gates, labels -----------------------------------------------------------------------------------------------


@query("row_confidence", f"with {SCORED_SQL} select frame, round(confidence, 6) as confidence, anchor from s")
def row_confidence(spark, sf_dir):
    return _r(scored(spark, sf_dir).select("frame", "confidence", "anchor"), {"confidence": 6})


_GATE_SQL = """case when not geometry_ok then 'homography_not_found' when good < 12 then 'not_enough_good_matches' when inliers < 12 then 'not_enough_inliers' when ratio < 0.25 then 'weak_inlier_ratio'
  when not inside then 'projected_center_outside' when frame % 17 = 0 then 'bad_homography_geometry' when 4 * area > 1 then 'reference_inliers_scattered_area' when 2.5 * width > 1 then 'reference_inliers_scattered_width'
  when 2 * height > 1 then 'reference_inliers_scattered_height' else 'accepted' end"""


def _gate():
    return scalars.gate_reason("geometry_ok", "good", "inliers", "ratio", "inside", F.col("frame") % 17 != 0, F.col("area") * 4, F.col("width") * 2.5, F.col("height") * 2, "area")


@query("gate_reason", f"with {PREDICTIONS_SQL} select frame, {_GATE_SQL} as gate_reason from p")
def gate_reason(spark, sf_dir):
    return predictions(spark, sf_dir).select("frame", _gate().alias("gate_reason"))


_VISUAL_SQL = """(1.35e0 * ln(1 + inliers) + 0.45e0 * ln(1 + good) + 1.10e0 * similarity + 1.25e0 * ratio - greatest(0e0, (inliers - 35e0) / 80) - case when inside then 0 else 2.5e0 end
  - case when geometry_ok then 0 else 1.5e0 end - 1.25e0 * greatest(0e0, area - 0.12e0))"""


def _visual():
    return scalars.visual_score("inliers", "good", "similarity", "ratio", "inliers", "inside", "geometry_ok", "area")


@query("visual_score", f"with {PREDICTIONS_SQL} select frame, round({_VISUAL_SQL}, 6) as visual_score from p")
def visual_score(spark, sf_dir):
    return _r(predictions(spark, sf_dir).select("frame", _visual().alias("visual_score")), {"visual_score": 6})


@query(
    "select_visual",
    f"""with {PREDICTIONS_SQL}, v as (select *, {_VISUAL_SQL} as v, {_GATE_SQL} as gate_reason from p),
r as (select *, row_number() over (partition by track, frame // 20 order by v desc, frame) as k from v)
select track, frame // 20 as shot, frame, gate_reason, gate_reason = 'accepted' as accepted from r where k = 1""",
)
def select_visual(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumns({"shot": F.floor(F.col("frame") / 20), "visual_score": _visual(), "gate_reason": _gate()})
    return track.select_visual(p.drop("accepted"), "track", "shot", "frame").select("track", "shot", "frame", "gate_reason", "accepted")


@query(
    "timecode",
    """select event_id as frame, case when event_type = 'error' or t < 0 then '' else
  printf('%02d:%02d:%02d.%03d', (round_even(t * 1000, 0)::bigint // 3600000), (round_even(t * 1000, 0)::bigint // 60000) % 60, (round_even(t * 1000, 0)::bigint // 1000) % 60, round_even(t * 1000, 0)::bigint % 1000) end as timecode
from (select *, event_id * 0.0005e0 as t from events)""",
)
def timecode(spark, sf_dir):
    p = predictions(spark, sf_dir)
    seconds = F.when(F.col("event_type") != "error", F.col("frame") * F.lit(0.0005))
    return p.select("frame", scalars.timecode(seconds).alias("timecode"))


@query(
    "alias_coalesce",
    """select event_id as frame, coalesce(a, b, c) as value, case when a is not null then 'confidence' when b is not null then 'homography_inliers' when c is not null then 'value' end as source
from (select event_id, case when event_id % 4 = 0 then value end as a, case when event_id % 3 = 0 then floor(value) end as b, case when event_id % 2 = 0 then value end as c from events)""",
)
def alias_coalesce(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = lambda every, c: F.when(F.col("event_id") % every == 0, c.cast("string")).otherwise("n/a")
    df = e.select(F.col("event_id").alias("frame"), text(4, F.col("value")).alias("confidence"), text(3, F.floor("value").cast("double")).alias("homography_inliers"), text(2, F.col("value")).alias("value"))
    picked = scalars.first_of(df, ["confidence", "missing_column", "homography_inliers", "value"])
    return df.withColumn("_p", picked).select("frame", F.col("_p.value").alias("value"), F.col("_p.source").alias("source"))


_UPGRADE_SQL = "case when frame % 19 = 0 then 'no_reference' when not accepted then 'candidate_not_accepted' when confidence < 5 then 'candidate_confidence_lt_5' when inliers < 8 then 'candidate_inliers_lt_8' when good < 15 then 'candidate_good_matches_lt_15' when ratio < 0.18 then 'candidate_inlier_ratio_lt_0.18' else 'candidate_quality_ok' end"


def _upgrade():
    return scalars.upgrade_reason(F.col("frame") % 19 != 0, "accepted", "confidence", "inliers", "good", "ratio", F.lit(None))


@query("quality_gate", f"with {SCORED_SQL} select frame, {_UPGRADE_SQL} as reason from s")
def quality_gate(spark, sf_dir):
    return scored(spark, sf_dir).select("frame", _upgrade().alias("reason"))


@query(
    "first_passing_candidate",
    f"""with {SCORED_SQL}, q as (select *, {_UPGRADE_SQL} as reason from s),
r as (select *, row_number() over (partition by track order by confidence desc, inliers desc, good desc, ratio desc, frame) as k from q),
o as (select track, min(k) filter (reason = 'candidate_quality_ok') as ok from r group by track)
select track, frame, k::int as rank, reason, coalesce(k = ok, false) as chosen from r join o using (track) where ok is null or k <= ok""",
)
def first_passing_candidate(spark, sf_dir):
    p = scored(spark, sf_dir).withColumn("reason", _upgrade())
    _, tried = merge.first_passing(p, ["track"], "reason", ["frame"])
    return tried.select("track", "frame", "rank", "reason", (F.col("reason") == scalars.QUALITY_OK).alias("chosen"))


@query(
    "scene_compatibility",
    """with v as (select vec_id, label, list_transform(embedding[1:8]::double[], lambda x: abs(x)) as s from embeddings),
j as (select a.vec_id, a.s as a, b.s as b from v a join v b on b.vec_id = a.vec_id + 1),
d as (select vec_id, abs(a[1] - b[1]) as sky, list_sum(list_transform(range(1, 9), lambda i: abs(a[i] - b[i]) * [2.0, 2.5, 1.2, 1.0, 0.8, 0.6, 0.5, 2.0][i]::double)) / 10.6e0 as d from j)
select vec_id, round(d, 6) as distance, case when sky > 0.22 then 'sky_horizon_mismatch' when d > 0.22 then 'scene_signature_mismatch' else 'scene_compatible' end as reason from d""",
)
def scene_compatibility(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double"))).alias("s"))
    j = v.select("vec_id", F.col("s").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("b")), "vec_id")
    return _r(j.select("vec_id", scalars.scene_distance("a", "b").alias("distance"), scalars.scene_reason("a", "b").alias("reason")), {"distance": 6})


@query(
    "inlier_spread",
    """select user_id as track, count(*) as n, round(case when count(*) >= 2 then least(1e0, (max(x) - min(x)) / 100) end, 6) as width, round(case when count(*) >= 2 then least(1e0, (max(y) - min(y)) / 50) end, 6) as height
from (select user_id, (event_id % 97)::double as x, (event_id % 41)::double as y from events) group by user_id""",
)
def inlier_spread(spark, sf_dir):
    p = predictions(spark, sf_dir).groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct((F.col("frame") % 97).cast("double").alias("x"), (F.col("frame") % 41).cast("double").alias("y"))).alias("points"))
    return _r(p.withColumn("_s", scalars.spread("points", F.lit(100.0), F.lit(50.0))).select("track", "n", F.col("_s.width").alias("width"), F.col("_s.height").alias("height")), {"width": 6, "height": 6})


# -- windows -------------------------------------------------------------------------------------------------------------

_NEIGHBOURS_SQL = """w as (select *, last_value(case when anchor then frame end ignore nulls) over (partition by track order by query_time_s, frame rows between 8 preceding and 1 preceding) as prev_frame,
  first_value(case when anchor then frame end ignore nulls) over (partition by track order by query_time_s, frame rows between 1 following and 8 following) as next_frame from s)"""


@query("nearest_anchor_context", f"with {SCORED_SQL}, {_NEIGHBOURS_SQL} select frame, anchor, prev_frame, next_frame from w")
def nearest_anchor_context(spark, sf_dir):
    d = windows.with_neighbours(scored(spark, sf_dir), F.col("anchor"), ["frame"], "track", TRACK_ORDER, 8)
    return d.select("frame", "anchor", F.col("prev.frame").alias("prev_frame"), F.col("next.frame").alias("next_frame"))


_FILL_SQL = """f as (select *, last_value(case when accepted then {'t': query_time_s, 'a': latitude, 'o': longitude} end ignore nulls) over (partition by track order by query_time_s, frame rows between unbounded preceding and 1 preceding) as b,
  first_value(case when accepted then {'t': query_time_s, 'a': latitude, 'o': longitude} end ignore nulls) over (partition by track order by query_time_s, frame rows between 1 following and unbounded following) as n from p),
m as (select *, case when accepted then 'raw_kept' when b is not null and n is not null and n.t <> b.t then 'interpolate_previous_next' when b is not null then 'hold_previous' when n is not null then 'hold_next' else 'none' end as filtered_method,
  greatest(0e0, least(1e0, (query_time_s - b.t) / nullif(n.t - b.t, 0))) as al from f)"""


@query(
    "interpolate_gaps",
    f"""with {PREDICTIONS_SQL}, {_FILL_SQL}
select frame, filtered_method, round(case filtered_method when 'raw_kept' then latitude when 'interpolate_previous_next' then (1 - al) * b.a + al * n.a when 'hold_previous' then b.a when 'hold_next' then n.a end, 8) as filtered_latitude,
  round(case filtered_method when 'raw_kept' then longitude when 'interpolate_previous_next' then (1 - al) * b.o + al * n.o when 'hold_previous' then b.o when 'hold_next' then n.o end, 8) as filtered_longitude from m""",
)
def interpolate_gaps(spark, sf_dir):
    out = windows.fill_path(predictions(spark, sf_dir), F.col("accepted"), "track", TRACK_ORDER, "query_time_s")
    return _r(out.select("frame", "filtered_method", "filtered_latitude", "filtered_longitude"), {"filtered_latitude": 8, "filtered_longitude": 8})


def _with_cells(spark, sf_dir):
    p, cells = placed_cells(spark, sf_dir)
    return joins.assign_cell(p, cells, "frame")


_CELLED_SQL = f"""{SCORED_SQL}, {CELL_SQL}, g as (
  select xy.frame, min(cell_id)::int as cell_id from xy join cells on east_m between x_min_m - 1e-9 and x_max_m + 1e-9 and north_m between y_min_m - 1e-9 and y_max_m + 1e-9 group by xy.frame),
z as (select xy.*, g.cell_id from xy left join g on xy.frame = g.frame)"""
_CONTEXT_SQL = f"""{_CELLED_SQL}, n as (
  select *, last_value(case when anchor then cell_id end ignore nulls) over (partition by track order by query_time_s, frame rows between 8 preceding and 1 preceding) as pc,
    first_value(case when anchor then cell_id end ignore nulls) over (partition by track order by query_time_s, frame rows between 1 following and 8 following) as nc from z)"""


@query(
    "context_regions",
    f"""with {_CONTEXT_SQL} select frame, case when pc = nc then 'between_same_grid_anchors' when pc is not null and nc is not null then 'between_different_grid_anchors' when pc is not null then 'after_previous_grid_anchor' when nc is not null then 'before_next_grid_anchor' else 'no_nearby_anchor_context' end as context_reason,
  case when pc = nc or nc is null then coalesce(pc::varchar, '') when pc is null then nc::varchar else pc || ';' || nc end as context_regions from n""",
)
def context_regions(spark, sf_dir):
    d = windows.context_regions(_with_cells(spark, sf_dir), "anchor", "cell_id", "track", TRACK_ORDER)
    return d.select("frame", "context_reason", F.array_join(F.col("context_regions").cast("array<string>"), ";").alias("context_regions"))


_CONSENSUS = "case when pc is not null and pc = nc then pc when anchor then cell_id when nc is null then pc when pc is null then nc end"


@query("consensus_region", f"with {_CONTEXT_SQL} select frame, ({_CONSENSUS})::int as consensus_region from n")
def consensus_region(spark, sf_dir):
    return windows.consensus_region(_with_cells(spark, sf_dir), "anchor", "cell_id", "track", TRACK_ORDER).select("frame", "consensus_region")


@query(
    "rerun_plan",
    f"""with {_CONTEXT_SQL}, r as (select *, case when pc = nc or nc is null then list_value(pc) when pc is null then list_value(nc) else list_value(pc, nc) end as ids from n)
select frame, case when anchor then 'anchor_keep' when pc is null and nc is null then 'no_context_skip' when not accepted then 'rejected_or_weak_in_grid_context' when not list_contains(ids, cell_id) then 'accepted_jump_to_non_context_grid' when confidence < 8 then 'accepted_low_confidence_in_grid_context' else 'accepted_keep' end as reason from r""",
)
def rerun_plan(spark, sf_dir):
    d = windows.context_regions(_with_cells(spark, sf_dir), "anchor", "cell_id", "track", TRACK_ORDER)
    return d.select("frame", scalars.rerun_reason("anchor", "context_regions", "accepted", "cell_id", F.lit(None).cast("double"), "confidence").alias("reason"))


@query(
    "region_status",
    f"""with {_CONTEXT_SQL}, k as (select *, {_CONSENSUS} as consensus, {haversine_sql("latitude", "longitude", "32.10e0", "35.20e0")} as d from n)
select frame, case when consensus is null then 'no_consensus_region' when anchor and cell_id = consensus then 'anchor_consistent' when accepted and d <= 180 then 'accepted_near_consensus' when accepted and d > 180 then 'suspicious_jump_from_consensus'
  when not accepted then 'rejected_inside_consensus_context' else 'low_confidence_consensus_context' end as status from k""",
)
def region_status(spark, sf_dir):
    d = windows.consensus_region(_with_cells(spark, sf_dir), "anchor", "cell_id", "track", TRACK_ORDER)
    distance = geo.haversine_m("latitude", "longitude", *ORIGIN)
    return d.select("frame", scalars.region_status("consensus_region", "cell_id", "anchor", "accepted", distance).alias("status"))


@query(
    "fill_in_region",
    f"""with {_CELLED_SQL}, n as (
  select *, last_value(case when anchor then {{'t': query_time_s, 'a': latitude, 'o': longitude, 'c': cell_id}} end ignore nulls) over (partition by track order by query_time_s, frame rows between 8 preceding and 1 preceding) as b,
    first_value(case when anchor then {{'t': query_time_s, 'a': latitude, 'o': longitude, 'c': cell_id}} end ignore nulls) over (partition by track order by query_time_s, frame rows between 1 following and 8 following) as f from z),
m as (select *, b.c = cell_id and f.c = cell_id and f.t > b.t as ok, greatest(0e0, least(1e0, (query_time_s - b.t) / nullif(f.t - b.t, 0))) as al from n)
select frame, round(case when ok then b.a * (1 - al) + f.a * al end, 8) as corrected_latitude, round(case when ok then b.o * (1 - al) + f.o * al end, 8) as corrected_longitude from m""",
)
def fill_in_region(spark, sf_dir):
    d = windows.fill_in_region(_with_cells(spark, sf_dir), "anchor", "cell_id", "cell_id", "track", TRACK_ORDER, "query_time_s")
    return _r(d.select("frame", "corrected_latitude", "corrected_longitude"), {"corrected_latitude": 8, "corrected_longitude": 8})


@query(
    "same_cell_support",
    f"""with {_CELLED_SQL}, o as (select *, row_number() over (partition by track order by query_time_s, frame) as rn from z)
select a.frame, count(b.frame) as same_cell_support from o a left join o b on a.track = b.track and b.accepted and a.cell_id = b.cell_id and abs(a.rn - b.rn) <= 8 and a.rn <> b.rn group by a.frame""",
)
def same_cell_support(spark, sf_dir):
    return windows.same_cell_support(_with_cells(spark, sf_dir), "accepted", "cell_id", "track", TRACK_ORDER).select("frame", "same_cell_support")


@query("anchors_per_cell", f"with {_CELLED_SQL} select cell_id, count(*) as anchor_count from z where anchor group by cell_id order by 2 desc, 1 limit 5")
def anchors_per_cell(spark, sf_dir):
    return stats.anchors_per_cell(_with_cells(spark, sf_dir), F.col("anchor"), "cell_id", 5)


# -- components and sweeps -----------------------------------------------------------------------------------------------

_PAIRS_SQL = f"""{SCORED_SQL}, q as (select *, row_number() over (partition by track order by frame) as rk from s where anchor),
e as (select a.track, a.frame as a, b.frame as b, {haversine_sql("a.latitude", "a.longitude", "b.latitude", "b.longitude")} as d, abs(b.query_time_s - a.query_time_s) as t, b.rk - a.rk as gap
  from q a join q b on a.track = b.track and a.rk < b.rk),
k as (select *, case when t > 1e-6 then d / t end as v from e)"""


def seeds(spark, sf_dir):
    return scored(spark, sf_dir).filter("anchor").select("track", "frame", "query_time_s", "latitude", "longitude", "confidence")


@query("seed_pairs", f"with {_PAIRS_SQL} select track, a, b, round(d, 3) as distance_m from k where d <= 180 and (v is null or v <= 25)")
def seed_pairs(spark, sf_dir):
    return _r(joins.pairs_in_track(seeds(spark, sf_dir), "track", "frame", 180.0, 25.0).drop("speed_mps"), {"distance_m": 3})


@query("support_pairs", f"with {_PAIRS_SQL} select track, a, b, round(d, 3) as distance_m from k where d <= 400 and gap <= 3 and (v is null or v <= 30)")
def support_pairs(spark, sf_dir):
    return _r(joins.pairs_in_track(seeds(spark, sf_dir), "track", "frame", 400.0, 30.0, 3).drop("speed_mps"), {"distance_m": 3})


_COMPONENTS_SQL = f"""with recursive {_PAIRS_SQL}, u as (select track, a as x, b as y from k where d <= 180 and (v is null or v <= 25) union all select track, b, a from k where d <= 180 and (v is null or v <= 25)),
r(track, frame, c) as (select track, frame, frame from q union select r.track, u.y, r.c from r join u on u.track = r.track and u.x = r.frame),
l as (select track, frame, min(c) as component from r group by all)"""


@query("seed_components", f"{_COMPONENTS_SQL} select track, frame, component from l")
def seed_components(spark, sf_dir):
    s = seeds(spark, sf_dir)
    return repair.track_components(s, joins.pairs_in_track(s, "track", "frame", 180.0, 25.0), "track", "frame").select("track", "frame", "component")


@query(
    "dominant_component",
    f"""{_COMPONENTS_SQL}, g as (select l.track, component, count(*) as size, sum(confidence) as sc, max(query_time_s) - min(query_time_s) as span from l join q on q.track = l.track and q.frame = l.frame group by all),
b as (select *, row_number() over (partition by track order by size desc, sc desc, span desc, component) as n, sum(size) over (partition by track) as total from g)
select l.track, l.frame, l.component, g.size as component_size, b.total < 4 or (b.size >= 4 and b.component = l.component) as seed_trusted
from l join g on g.track = l.track and g.component = l.component join b on b.track = l.track and b.n = 1""",
)
def dominant_component(spark, sf_dir):
    return repair.keep_dominant(seeds(spark, sf_dir), "track", "frame").select("track", "frame", "component", "component_size", "seed_trusted")


@query(
    "seed_support",
    f"""with recursive {_PAIRS_SQL}, es as (select track, a, b from k where d <= 400 and gap <= 8 and (v is null or v <= 30)),
u as (select track, a as x, b as y from es union all select track, b, a from es),
r(track, frame, c) as (select track, frame, frame from q union select r.track, u.y, r.c from r join u on u.track = r.track and u.x = r.frame),
l as (select track, frame, min(c) as component from r group by all), dg as (select track, x as frame, count(*) as support_count from u group by all),
g as (select l.track, component, count(*) as size, sum(confidence) as sc, max(query_time_s) - min(query_time_s) as span from l join q on q.track = l.track and q.frame = l.frame group by all),
b as (select *, row_number() over (partition by track order by size desc, sc desc, span desc, component) as n, sum(size) over (partition by track) as total from g)
select l.track, l.frame, l.component, coalesce(dg.support_count, 0) as support_count, b.total >= 4 and b.size >= 4 and b.component = l.component and coalesce(dg.support_count, 0) >= 1 as seed_trusted
from l join b on b.track = l.track and b.n = 1 left join dg on dg.track = l.track and dg.frame = l.frame""",
)
def seed_support(spark, sf_dir):
    return repair.keep_supported(seeds(spark, sf_dir), "track", "frame", 400.0).select("track", "frame", "component", "support_count", "seed_trusted")


def _gap_sql(a: str, b: str) -> str:
    return haversine_sql(f"{a}.la", f"{a}.lo", f"{b}.la", f"{b}.lo")


def _sweep_sql(ctes: str, source: str, flag: str, kept: str, never: str, verdict: str, sweeps: int, out: tuple[str, str], context: int = 10) -> str:
    """Rows of a track as a list, visited in order, several times over; a row sees the flags as they are then. In `verdict`: r the row, p and
    n its flagged neighbours (null if there is none within `context` rows), i its place, ok the flags, rows, size."""
    place = "query_time_s, frame"
    return f"""with recursive {ctes}, src as (
  select track, list({{'la': latitude, 'lo': longitude, 't': query_time_s, 'k': confidence, 'c': {"cell_id" if "cell_id" in ctes else "0"}}} order by {place}) as rows, list(frame order by {place}) as frames,
    list({flag} order by {place}) as ok0, count(*)::int as size from {source} group by track),
w(track, step, ok, why) as (
  select track, 0, ok0, list_transform(ok0, lambda x: case when x then '{kept}' else '{never}' end) from src
  union all
  select track, step + 1, case when v is null then ok else list_transform(ok, lambda x, j: x and j <> i) end, case when v is null then why else list_transform(why, lambda x, j: case when j = i then v else x end) end
  from (
    select *, case when ok[i] then {verdict} end as v
    from (
      select *, rows[i] as r, rows[pi] as p, rows[ni] as n
      from (
        select w.track, w.step, w.ok, w.why, src.rows, src.size, w.step % src.size + 1 as i,
          list_max(list_filter(range(greatest(1, w.step % src.size + 1 - {context}), w.step % src.size + 1), lambda j: w.ok[j])) as pi,
          list_min(list_filter(range(w.step % src.size + 2, least(src.size, w.step % src.size + 1 + {context}) + 1), lambda j: w.ok[j])) as ni
        from w join src on src.track = w.track where w.step < {sweeps} * src.size))))
select w.track, unnest(frames) as frame, unnest(ok) as {out[0]}, unnest(why) as {out[1]} from w join src on src.track = w.track where w.step = {sweeps} * src.size"""


_PATH_VERDICT = f"""case
  when pi is not null and ni is not null and {_gap_sql("r", "p")} >= 160 and {_gap_sql("r", "n")} >= 160 and p.c = n.c and r.c <> p.c then 'isolated_grid_teleport_between_same_context'
  when (coalesce({_gap_sql("r", "p")} >= 160, false) or coalesce({_gap_sql("r", "n")} >= 160, false))
    and len(list_filter(range(greatest(1, i - 8), least(size, i + 8) + 1), lambda j: j <> i and ok[j] and coalesce(rows[j].c = r.c, false))) < 1 and (pi is not null and ni is not null or r.k < 18)
    then case when pi is not null and ni is not null then 'far_jump_with_low_same_grid_support' else 'one_sided_far_jump_with_low_same_grid_support' end
  when pi is not null and ni is not null and {_gap_sql("r", "p")} >= 160 and {_gap_sql("r", "n")} >= 160 and {_gap_sql("p", "n")} <= 120 then 'far_from_short_bridge_context' end"""


def _speed_sql(a: str, b: str) -> str:
    return f"(case when abs({a}.t - {b}.t) > 1e-6 then {_gap_sql(a, b)} / abs({a}.t - {b}.t) end)"


_SEED_VERDICT = f"""case when pi is null or ni is null then null
  when ({_gap_sql("p", "n")} <= 120 or coalesce({_speed_sql("p", "n")} <= 45, false)) and {_gap_sql("p", "r")} >= 160 and {_gap_sql("r", "n")} >= 160 then 'seed_rejected_isolated_teleport_between_reasonable_neighbors'
  when coalesce({_speed_sql("p", "r")} >= 45, false) and coalesce({_speed_sql("r", "n")} >= 45, false) then 'seed_rejected_speed_impossible_between_neighbors' end"""


@query("path_sweep", _sweep_sql(_CELLED_SQL, "z", "(accepted and confidence >= 0)", "path_consistent", "not_accepted", _PATH_VERDICT, 3, ("path_accepted", "path_reason")))
def path_sweep(spark, sf_dir):
    p = _with_cells(spark, sf_dir).withColumn("path_accepted", F.col("accepted") & (F.col("confidence") >= 0))
    return repair.sweep_path(p, "track", TRACK_ORDER).select("track", "frame", "path_accepted", "path_reason")


@query("seed_sweep", _sweep_sql(SCORED_SQL, "s", "anchor", "seed_kept", "not_a_seed", _SEED_VERDICT, 4, ("seed_trusted", "seed_reason")))
def seed_sweep(spark, sf_dir):
    p = scored(spark, sf_dir).withColumn("seed_trusted", F.col("anchor"))
    return repair.sweep_seeds(p, "track", TRACK_ORDER).select("track", "frame", "seed_trusted", "seed_reason")


@query(
    "leader_clusters",
    f"""with recursive {SCORED_SQL}, src as (
  select track, list({{'la': latitude, 'lo': longitude, 'k': confidence, 'f': frame}} order by confidence desc, query_time_s, frame) as rows, count(*)::int as size from s where anchor group by track),
w(track, step, regions, own) as (
  select track, 0, []::struct(a double, o double, n double)[], []::int[] from src
  union all
  select track, step + 1, case when best is null then list_append(regions, {{'a': r.la, 'o': r.lo, 'n': 1e0}}) else list_transform(regions, lambda g, j: case when j = best then {{'a': g.a + r.la, 'o': g.o + r.lo, 'n': g.n + 1e0}} else g end) end,
    list_append(own, coalesce(best, len(regions) + 1)::int)
  from (
    select *, case when list_min(ds) <= 120 then list_position(ds, list_min(ds)) end as best
    from (
      select w.*, src.rows[w.step + 1] as r, list_transform(w.regions, lambda g: {haversine_sql("src.rows[w.step + 1].la", "src.rows[w.step + 1].lo", "g.a / g.n", "g.o / g.n")}) as ds
      from w join src on src.track = w.track where w.step < src.size))),
a as (select w.track, unnest(src.rows) as r, unnest(w.own) as age from w join src on src.track = w.track where w.step = src.size),
g as (select track, age, count(*) as anchor_count, avg(r.la) as latitude, avg(r.lo) as longitude, median(r.k) as median_confidence, min(r.f) as min_frame, max(r.f) as max_frame from a group by track, age)
select track, (row_number() over (partition by track order by anchor_count desc, median_confidence desc, age))::int as region_id, anchor_count, round(latitude, 8) as latitude, round(longitude, 8) as longitude,
  round(median_confidence, 6) as median_confidence, min_frame, max_frame from g""",
)
def leader_clusters(spark, sf_dir):
    a = seeds(spark, sf_dir).withColumnRenamed("frame", "anchor_id")
    return _r(repair.regions_of(repair.leader_clusters(a, "track"), "track"), {"latitude": 8, "longitude": 8, "median_confidence": 6})


@query(
    "tail_rescue",
    f"""with recursive {SCORED_SQL}, h as (select *, anchor and percent_rank() over (partition by track order by query_time_s, frame) < 0.7 as trusted from s),
last as (select track, arg_max({{'la': latitude, 'lo': longitude, 't': query_time_s}}, (query_time_s, frame)) as e from h where trusted group by track),
src as (
  select h.track, list({{'la': latitude, 'lo': longitude, 't': query_time_s, 'f': frame}} order by query_time_s desc, frame desc) as rows, count(*)::int as size, any_value(e) as e
  from h join last on last.track = h.track where anchor and not trusted and query_time_s > e.t and confidence >= 8 group by h.track),
w(track, step, r, chain) as (
  select track, 1, rows[1], [rows[1].f] from src
  union all
  select track, step + 1, case when ok then x else r end, case when ok then list_append(chain, x.f) else chain end
  from (
    select *, {_gap_sql("x", "r")} <= 420 and coalesce({_speed_sql("x", "r")} <= 35, true) as ok
    from (select w.*, src.rows[w.step + 1] as x from w join src on src.track = w.track where w.step < src.size))),
kept as (select w.track, w.chain from w join src on src.track = w.track where w.step = src.size and {_gap_sql("e", "r")} <= 420 and coalesce({_speed_sql("e", "r")} <= 35, true))
select h.track, h.frame, h.trusted or coalesce(list_contains(kept.chain, h.frame), false) as seed_trusted, coalesce(list_contains(kept.chain, h.frame), false) as tail_rescued from h left join kept on kept.track = h.track""",
)
def tail_rescue(spark, sf_dir):
    half = F.percent_rank().over(Window.partitionBy("track").orderBy(*TRACK_ORDER))
    p = scored(spark, sf_dir).withColumn("initial_seed", F.col("anchor")).withColumn("seed_trusted", F.col("anchor") & (half < 0.7))
    return repair.rescue_tail(p, "track", TRACK_ORDER, gap_s=1e9).select("track", "frame", "seed_trusted", "tail_rescued")


_EXPECTED_SQL = _FILL_SQL.replace("case when accepted", "case when anchor").replace("from p)", "from s)")
_NOT_SEEDS_SQL = f"""{SCORED_SQL}, {_EXPECTED_SQL},
x as (select track, frame, query_time_s, case filtered_method when 'interpolate_previous_next' then (1 - al) * b.a + al * n.a when 'hold_previous' then b.a when 'hold_next' then n.a end as latitude,
  case filtered_method when 'interpolate_previous_next' then (1 - al) * b.o + al * n.o when 'hold_previous' then b.o when 'hold_next' then n.o end as longitude from m where filtered_method not in ('raw_kept', 'none')),
y as (select track, frame, query_time_s, {_XY_SQL} from x)"""


@query(
    "path_windows",
    f"""with recursive {_NOT_SEEDS_SQL}, o as (select *, row_number() over (partition by track order by query_time_s, frame) as rn from y),
w(track, rn, frame, e, u, id, n, se, su) as (
  select track, rn, frame, east_m, north_m, 1, 1, east_m, north_m from o where rn = 1
  union all
  select track, rn, frame, east_m, north_m, case when new then id + 1 else id end, case when new then 1 else n + 1 end, case when new then east_m else se + east_m end, case when new then north_m else su + north_m end
  from (
    select o.track, o.rn, o.frame, o.east_m, o.north_m, w.id, w.n, w.se, w.su, w.n >= 45 or sqrt(power(o.east_m - w.se / w.n, 2) + power(o.north_m - w.su / w.n, 2)) > 120 as new
    from w join o on o.track = w.track and o.rn = w.rn + 1))
select track, id::int as path_window_id, count(*) as frame_count, min(frame) as min_query_frame, max(frame) as max_query_frame, round(avg(e), 3) as east_m, round(avg(u), 3) as north_m from w group by track, id""",
)
def path_windows(spark, sf_dir):
    p = windows.expected_path(scored(spark, sf_dir).withColumn("seed_trusted", F.col("anchor")), "track", TRACK_ORDER, "query_time_s")
    wanted = p.filter(scalars.marked_for_rerun("expected_latitude", "accepted", "seed_trusted", "anchor"))
    w = repair.path_windows(joins.with_local_xy(wanted, ORIGIN, "expected_latitude", "expected_longitude"), "track", TRACK_ORDER)
    return _r(repair.window_stats(w, "track", "frame"), {"east_m": 3, "north_m": 3})


def filter_input(spark, sf_dir):
    return predictions(spark, sf_dir).withColumns({"visual_score": _visual(), "gate_reason": _gate()})


@query(
    "ema_track_filter",
    f"""with recursive {PREDICTIONS_SQL}, v as (select *, {_VISUAL_SQL} as vis, {_GATE_SQL} as g, row_number() over (partition by track order by query_time_s, frame) as rn from p),
f(track, rn, frame, la, lo, t, fl, out_la, acc, reason) as (
  select track, rn, frame, case when g = 'accepted' then latitude end, case when g = 'accepted' then longitude end, case when g = 'accepted' then query_time_s end, case when g = 'accepted' then matched_flight end,
    case when g = 'accepted' then latitude end, g = 'accepted', g from v where rn = 1
  union all
  select track, rn, frame, case when not acc then pla when pla is null then latitude else 0.65e0 * pla + 0.35e0 * latitude end, case when not acc then plo when pla is null then longitude else 0.65e0 * plo + 0.35e0 * longitude end,
    case when acc or pla is not null then query_time_s end, case when acc then matched_flight else pfl end,
    case when not acc then pla when pla is null then latitude else 0.65e0 * pla + 0.35e0 * latitude end, acc, case when acc then 'accepted' else why || case when pla is null then '' else '_held_last' end end
  from (
    select *, case when pla is not null and d > greatest(180, 2.2e0 * al) and not (inliers >= 24 and ratio >= 0.35e0) then 'temporal_jump_rejected' else g end as why,
      g = 'accepted' and not coalesce(pla is not null and d > greatest(180, 2.2e0 * al) and not (inliers >= 24 and ratio >= 0.35e0), false) as acc
    from (
      select v.*, f.la as pla, f.lo as plo, f.fl as pfl, {haversine_sql("f.la", "f.lo", "v.latitude", "v.longitude")} as d,
        greatest(55e0, 18e0 * greatest(greatest(v.query_time_s - f.t, 0e0), 0.1e0) * 2) * case when v.inliers >= 24 then 1.8e0 else 1e0 end as al
      from f join v on v.track = f.track and v.rn = f.rn + 1)))
select track, frame, round(out_la, 7) as filtered_latitude, acc as filter_accepted, reason as filter_reason from f""",
)
def ema_track_filter(spark, sf_dir):
    out = track.filter_tracks(filter_input(spark, sf_dir), "track", "frame", "frame")
    return _r(out.select("track", "frame", "filtered_latitude", "filter_accepted", "filter_reason"), {"filtered_latitude": 7})


def _filter_sql(ctes: str, candidates: str, frame: str, time: str, tie: str, advance: bool, raw: bool) -> str:
    """The track filter as a fold over frames, each with the list of its candidates (columns latitude, longitude, matched_flight, inliers, ratio, vis, g)."""
    away = haversine_sql("w.la", "w.lo", "c.la", "c.lo")
    allowed = "(greatest(55e0, 36e0 * greatest(src.t - w.t, 0.1e0)) * case when c.i >= 24 then 1.8e0 else 1e0 end)"
    far = f"({away} > greatest(180e0, 2.2e0 * {allowed}) and not (c.i >= 24 and c.q >= 0.35e0))"
    judged = f"""list_transform(src.cs, lambda c: case when w.la is null then {{'la': c.la, 'lo': c.lo, 'f': c.f, 'why': c.g, 'd': null::double, 'v': c.v, 's': c.v}}
      else {{'la': c.la, 'lo': c.lo, 'f': c.f, 'why': case when {far} then 'temporal_jump_rejected' else c.g end, 'd': {away}, 'v': c.v, 's': c.v - 1.3e0 * {away} / {allowed} + case when c.f = w.f then 0.2e0 else 0e0 end}} end)"""
    held = "src.t" if advance else "w.t"
    return f"""with recursive {ctes}, fr as (
  select track, {frame} as fr, {time} as t, list({{'la': latitude, 'lo': longitude, 'f': matched_flight, 'i': inliers, 'q': ratio, 'v': vis, 'g': g}} order by {tie}) as cs from {candidates} group by all),
src as (select *, row_number() over (partition by track order by t, fr) as rn from fr),
w(track, rn, la, lo, t, f, out) as (
  select track, 0, null::double, null::double, null::double, null::varchar, null::struct(fr bigint, t double, la double, lo double, ok boolean, why varchar, d double, v double, s double) from src where rn = 1
  union all
  select track, rn, case when not ok then la else na end, case when not ok then lo else no end, case when ok or la is null then case when ok then nt end else ht end, case when ok then best.f else f end,
    {{'fr': fr, 't': nt, 'la': case when ok then na when la is not null then la {"else best.la" if raw else ""} end, 'lo': case when ok then no when la is not null then lo {"else best.lo" if raw else ""} end, 'ok': ok,
      'why': case when ok or la is null then best.why else best.why || '_held_last' end, 'd': best.d, 'v': best.v, 's': best.s}}
  from (
    select *, best.why = 'accepted' as ok, case when la is null then best.la else 0.65e0 * la + 0.35e0 * best.la end as na, case when la is null then best.lo else 0.65e0 * lo + 0.35e0 * best.lo end as no
    from (
      select *, js[list_position(list_transform(js, lambda x: x.s), list_max(list_transform(js, lambda x: x.s)))] as best
      from (
        select src.track, src.rn, src.fr, src.t as nt, {held} as ht, w.la, w.lo, w.f, {judged} as js
        from w join src on src.track = w.track and src.rn = w.rn + 1))))
select track, out.fr as {frame}, round(out.t, 3) as query_time_s, round(out.la, 7) as filtered_latitude, round(out.lo, 7) as filtered_longitude, out.ok as filter_accepted, out.why as filter_reason,
  round(out.d, 3) as filter_distance_m, round(out.v, 6) as filter_visual_score, round(out.s, 6) as filter_fused_score from w where rn > 0"""


_FILTERED = {"query_time_s": 3, "filtered_latitude": 7, "filtered_longitude": 7, "filter_distance_m": 3, "filter_visual_score": 6, "filter_fused_score": 6}
_JUDGED_SQL = f"{PREDICTIONS_SQL}, v as (select *, {_VISUAL_SQL} as vis, {_GATE_SQL} as g, frame // 50 as shot, (frame // 50) * 30e0 as shot_s from p)"


@query("online_track_filter", _filter_sql(_JUDGED_SQL, "v", "shot", "shot_s", "frame", True, True))
def online_track_filter(spark, sf_dir):
    """Several candidates a frame: the neighbouring events of a track count as candidates of one shot."""
    p = filter_input(spark, sf_dir).withColumns({"shot": F.floor(F.col("frame") / 50), "query_time_s": F.floor(F.col("frame") / 50).cast("double") * 30})
    return _r(track.filter_tracks(p, "track", "shot", "frame", track.FilterConfig(raw_without_state=True)), _FILTERED)


@query("refilter_no_clock", _filter_sql(_JUDGED_SQL, "v", "frame", "query_time_s", "frame", False, False))
def refilter_no_clock(spark, sf_dir):
    return _r(track.filter_tracks(filter_input(spark, sf_dir), "track", "frame", "frame", track.FilterConfig(advance_on_hold=False)), _FILTERED)


_LOOKED_UP_SQL = f"""{PREDICTIONS_SQL}, i as (select frame as rf, matched_flight as rm, latitude as rla, longitude as rlo from p where frame % 3 <> 0),
j as (select p.*, rf, rm, rla, rlo from p left join i on rf = p.frame + 1),
v as (select track, frame, query_time_s, rla as latitude, rlo as longitude, rm as matched_flight, inliers, 1e0 as ratio, case when good < 12 then 'not_enough_good_matches' when inliers < 12 then 'not_enough_inliers' else 'accepted' end as g,
  1.35e0 * ln(1 + inliers) + 0.45e0 * ln(1 + good) + 1.10e0 * similarity + 1.25e0 as vis from j where rf is not null)"""


@query(
    "derive_target",
    _filter_sql(_LOOKED_UP_SQL, "v", "frame", "query_time_s", "frame", True, False).replace("select track, out.fr as frame,", "select track, out.fr as frame, 'center' as prediction_target,").replace(
        "round(out.t, 3) as query_time_s, round(out.la, 7) as filtered_latitude, round(out.lo, 7) as filtered_longitude,", "round(out.la, 7) as pred_latitude, round(out.lo, 7) as pred_longitude,").split("\n  round(out.d")[0].rstrip(",")
    + " from w where rn > 0 union all select track, frame, 'center', null, null, false, 'missing_reference_match' from j where rf is null",
)
def derive_target(spark, sf_dir):
    p = predictions(spark, sf_dir)
    index = p.filter("frame % 3 <> 0").select(F.col("matched_flight").alias("flight_id"), F.col("frame").alias("frame_index"), F.col("frame").alias("ref_index"), F.col("latitude").alias("center_lat"), F.col("longitude").alias("center_lon"), F.col("latitude").alias("drone_lat"), F.col("longitude").alias("drone_lon"))
    rows = p.select("track", "frame", "query_time_s", F.concat(F.lit("f"), ((F.col("frame") + 1) % 3).cast("string")).alias("matched_reference_flight"), (F.col("frame") + 1).alias("matched_reference_frame_index"),
                    F.col("good").alias("orb_good_matches"), F.col("inliers").alias("homography_inliers"), F.col("similarity").alias("retrieval_similarity"))
    out = pipelines.derive_target(rows, index, "track", "frame", "frame")
    return _r(out.select("track", "frame", "prediction_target", "pred_latitude", "pred_longitude", "filter_accepted", "filter_reason"), {"pred_latitude": 7, "pred_longitude": 7})


@query(
    "merge_region_reruns",
    f"""with {_CONTEXT_SQL}, even as (select * from n where frame % 2 = 0), odd as (select *, frame - 1 as bf from z where frame % 2 = 1 and accepted),
kk as (select o.bf, o.latitude as rla, o.confidence as rc, row_number() over (partition by o.bf order by o.confidence desc, o.frame) as rk from odd o join even e on e.frame = o.bf where not e.anchor and (o.cell_id = e.pc or o.cell_id = e.nc)),
jj as (select e.*, kk.rla, kk.rc, kk.bf is not null and (not e.accepted or kk.rc >= e.confidence + 0.5) as rep from even e left join kk on kk.bf = e.frame and kk.rk = 1)
select frame, round(case when rep then rla else latitude end, 8) as latitude, round(case when rep then rc else confidence end, 6) as confidence, rep as replaced from jj""",
)
def merge_region_reruns(spark, sf_dir):
    d = windows.context_regions(_with_cells(spark, sf_dir), "anchor", "cell_id", "track", TRACK_ORDER)
    base = d.filter("frame % 2 = 0")
    plan = base.select("frame", (~F.col("anchor")).alias("will_rerun"), "context_regions")
    reruns = d.filter("frame % 2 = 1").select((F.col("frame") - 1).alias("frame"), F.col("frame").alias("rerun_order"), "cell_id", "latitude", "longitude", "accepted", "confidence")
    out = pipelines.merge_region_reruns(base.select("frame", "latitude", "longitude", "accepted", "confidence"), plan, reruns, "frame", "cell_id", "context_regions", ["latitude", "longitude"])
    return _r(out.select("frame", "latitude", "confidence", "replaced"), {"latitude": 8, "confidence": 6})


# -- merging -------------------------------------------------------------------------------------------------------------


@query(
    "merge_best_rerun",
    f"""with {SCORED_SQL}, b as (select * from s where frame % 2 = 0),
r as (select frame - 1 as base_frame, frame as rerun_frame, latitude, longitude, accepted, confidence, inliers from s where frame % 2 = 1 union all select frame - 3, frame, latitude, longitude, accepted, confidence, inliers from s where frame % 2 = 1),
k as (select *, row_number() over (partition by base_frame order by confidence desc, rerun_frame) as n from r where accepted),
j as (select b.*, k.latitude as rla, k.confidence as rc, k.base_frame is not null and (not b.accepted or k.confidence >= b.confidence + 0.5) as rep from b left join k on k.base_frame = b.frame and k.n = 1)
select frame, round(case when rep then rla else latitude end, 8) as latitude, round(case when rep then rc else confidence end, 6) as confidence, rep as replaced from j""",
)
def merge_best_rerun(spark, sf_dir):
    s = scored(spark, sf_dir).select("frame", "latitude", "longitude", "accepted", "confidence", "inliers")
    odd = s.filter("frame % 2 = 1").withColumn("rerun_frame", F.col("frame"))
    reruns = merge.union_all([odd.withColumn("frame", F.col("frame") - k) for k in (1, 3)])
    out = merge.best_rerun(s.filter("frame % 2 = 0"), reruns, "frame", "confidence", "accepted", "rerun_frame", ["latitude", "longitude", "accepted", "confidence"])
    return _r(out.select("frame", "latitude", "confidence", "replaced"), {"latitude": 8, "confidence": 6})


@query(
    "merge_plan_gated",
    f"""with {SCORED_SQL}, b as (select * from s where frame % 2 = 0), pl as (select frame, anchor as seed_trusted, frame % 6 <> 0 as will_rerun, frame % 4 as w, 32.10e0 as ela, 35.20e0 as elo from b),
cd as (select frame - 1 as f, frame as cf, latitude, longitude, confidence, accepted, (frame - 1) % 4 as w from s where frame % 2 = 1),
g as (select cd.*, {haversine_sql("cd.latitude", "cd.longitude", "ela", "elo")} as d from cd join pl on pl.frame = cd.f where will_rerun and pl.w = cd.w and accepted and confidence >= 6),
k as (select *, row_number() over (partition by f order by confidence desc, d, cf) as n from g where d <= 500)
select b.frame, round(case when seed_trusted then b.latitude when k.f is not null then k.latitude else ela end, 8) as final_latitude, seed_trusted or k.f is not null as final_accepted,
  case when seed_trusted then 'seed_keep' when k.f is not null then 'local_rerun' else 'path_expected_origin' end as final_method
from b join pl using (frame) left join k on k.f = b.frame and k.n = 1""",
)
def merge_plan_gated(spark, sf_dir):
    s = scored(spark, sf_dir)
    base = s.filter("frame % 2 = 0").select("frame", "latitude", "longitude", "anchor")
    plan = base.select("frame", F.col("anchor").alias("seed_trusted"), (F.col("frame") % 6 != 0).alias("will_rerun"), (F.col("frame") % 4).alias("path_window_id"), F.lit(ORIGIN[0]).alias("expected_latitude"), F.lit(ORIGIN[1]).alias("expected_longitude"), F.lit("origin").alias("expected_method"), F.col("frame").alias("plan_order"))
    odd = s.filter("frame % 2 = 1").withColumn("candidate_order", F.col("frame")).withColumn("frame", F.col("frame") - 1).withColumn("path_window_id", F.col("frame") % 4)
    gated = joins.plan_gate(odd.filter("accepted and confidence >= 6"), plan, "frame", "path_window_id", F.col("plan_distance_m") <= 500)
    return _r(merge.merge_plan(base, plan, gated, "frame").select("frame", "final_latitude", "final_accepted", "final_method"), {"final_latitude": 8})


@query(
    "region_gated_candidates",
    f"""with {_CONTEXT_SQL} select frame from n where (pc is not null or nc is not null) and not anchor and (cell_id = pc or cell_id = nc)""",
)
def region_gated_candidates(spark, sf_dir):
    d = windows.context_regions(_with_cells(spark, sf_dir), "anchor", "cell_id", "track", TRACK_ORDER).withColumn("will_rerun", ~F.col("anchor"))
    return joins.region_gate(d.select("frame", "cell_id"), d.select("frame", "will_rerun", "context_regions"), "frame", "cell_id", "context_regions").select("frame")


@query(
    "conservative_upgrade",
    f"""with {SCORED_SQL}, q as (select *, {_UPGRADE_SQL} as reason, frame - frame % 10 as bf from s where frame % 10 <> 0),
k as (select *, row_number() over (partition by bf order by confidence desc, inliers desc, good desc, ratio desc, frame) as n from q where reason = 'candidate_quality_ok'),
j as (select b.frame, b.latitude, b.accepted, k.latitude as rla, k.inliers as ci, k.bf, {haversine_sql("b.latitude", "b.longitude", "k.latitude", "k.longitude")} as d from s b left join k on k.bf = b.frame and k.n = 1 where b.frame % 10 = 0)
select frame, case when accepted then 'kept' when bf is null then 'no_quality_candidate' when ci < 8 then 'weak_cluster' when d > 400 then 'too_far_from_path' else 'upgraded' end as upgrade_status,
  round(case when not accepted and bf is not null and ci >= 8 and d <= 400 then rla else latitude end, 8) as latitude from j""",
)
def conservative_upgrade(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("reason", _upgrade())
    base = s.filter("frame % 10 = 0").select("frame", "latitude", "longitude", "accepted")
    candidates = s.filter("frame % 10 <> 0").withColumn("candidate", F.col("frame")).withColumn("frame", F.col("frame") - F.col("frame") % 10)
    refine = F.struct("latitude", "longitude", F.col("inliers").alias("cluster_inliers"))
    out = merge.upgrade(base, candidates, "frame", ~F.col("accepted"), "reason", refine, ["candidate"], most_m=400.0)
    return _r(out.select("frame", "upgrade_status", "latitude"), {"latitude": 8})


@query(
    "clear_and_override",
    f"""with {PREDICTIONS_SQL} select frame, case when accepted then inliers end as inliers, round(case when accepted then latitude else 32.10e0 end, 8) as latitude, round(latitude, 8) as original_latitude from p""",
)
def clear_and_override(spark, sf_dir):
    p = merge.with_originals(predictions(spark, sf_dir), ["latitude"])
    p = merge.overwrite_where(p, ~F.col("accepted"), {"latitude": F.lit(ORIGIN[0])})
    return _r(scalars.cleared_unless(p, F.col("accepted"), ["inliers"]).select("frame", "inliers", "latitude", "original_latitude"), {"latitude": 8, "original_latitude": 8})


# -- samples, lists, output ----------------------------------------------------------------------------------------------


@query("stride_sample", f"with {PREDICTIONS_SQL}, r as (select *, row_number() over (partition by track order by query_time_s, frame) - 1 as n from p) select track, frame from r where n % 5 = 0")
def stride_sample(spark, sf_dir):
    return windows.stride_sample(predictions(spark, sf_dir), 5, TRACK_ORDER, "track").select("track", "frame")


@query(
    "ordered_distinct",
    f"""with {PREDICTIONS_SQL}, f as (select track, event_type, min(frame) as k from p group by all) select track, string_agg(event_type, ';' order by k) as kinds from f group by track""",
)
def ordered_distinct(spark, sf_dir):
    f = predictions(spark, sf_dir).groupBy("track", "event_type").agg(F.min("frame").alias("k"))
    kinds = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "event_type"))), lambda x: x["event_type"]), ";")
    return f.groupBy("track").agg(kinds.alias("kinds"))


@query(
    "frame_list_expand",
    """select distinct unnest(range(a, a + 21, 7)) as frame from (select event_id * 10 as a from events) union select event_id as frame from events union select event_id + 3 from events""",
)
def frame_list_expand(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.select(F.concat(F.col("event_id") * 10, F.lit("-"), F.col("event_id") * 10 + 20, F.lit(":7, "), "event_id", F.lit("  "), F.col("event_id") + 3, F.lit(" # from an event")).alias("value"))
    return frame_lists.sorted_frames(lines)


@query(
    "kml_paths",
    f"""with {PREDICTIONS_SQL} select track, string_agg(printf('%.8f,%.8f,%.3f', longitude, latitude, 0e0), ' ' order by query_time_s, frame) as coordinates, count(*) as n_points from p where accepted group by track""",
)
def kml_paths(spark, sf_dir):
    return kml.path_lines(predictions(spark, sf_dir).filter("accepted"), "track", TRACK_ORDER)


@query(
    "numbered_points",
    f"""with {PREDICTIONS_SQL}, n as (select track, frame, row_number() over (order by track, frame) as number from p) select frame, number, case when number < 1000 then lpad(number::varchar, 3, '0') else number::varchar end as label from n""",
)
def numbered_points(spark, sf_dir):
    return kml.numbered_points(predictions(spark, sf_dir), ["track", "frame"]).select("frame", "number", "label")


# -- the entry points ----------------------------------------------------------------------------------------------------


@query(
    "reference_index",
    f"""with {_HEADINGS_SQL}, g as (select *, coalesce(nullif(inliers, 0), 80)::double / tan(radians(45e0)) as off from h),
d as (select *, radians(latitude) as f, radians(heading_deg) as th, off / 6371000e0 as a, sin(radians(latitude)) * cos(off / 6371000e0) + cos(radians(latitude)) * sin(off / 6371000e0) * cos(radians(heading_deg)) as sn from g)
select row_number() over (order by track::varchar, query_time_s, frame) - 1 as ref_index, track::varchar as flight_id, frame as frame_index, round(query_time_s, 3) as video_time_s, round(latitude, 8) as latitude, round(longitude, 8) as longitude, inliers::double as rel_alt,
  round(heading_deg, 6) as heading_deg, round(degrees(asin(greatest(-1e0, least(1e0, sn)))), 8) as center_lat, round(longitude + degrees(atan2(sin(th) * sin(a) * cos(f), cos(a) - sin(f) * sn)), 8) as center_lon, round(off, 4) as center_offset_m from d""",
)
def reference_index(spark, sf_dir):
    p = predictions(spark, sf_dir)
    frames = p.select(F.col("track").cast("string").alias("flight_id"), F.col("frame").alias("frame_index"), F.col("query_time_s").alias("video_time_s"), "latitude", "longitude", F.col("inliers").cast("double").alias("rel_alt"))
    index = pipelines.build_reference_index(frames, 45.0, default_altitude=80.0)
    return _r(index, {"video_time_s": 3, "latitude": 8, "longitude": 8, "heading_deg": 6, "center_lat": 8, "center_lon": 8, "center_offset_m": 4})


_LOCALIZED_SQL = """t as (
  select a.vec_id % 4 as track, a.vec_id as frame, a.vec_id::double as query_time_s, b.vec_id as r, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity,
    row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) as rank
  from embeddings a, embeddings b where a.vec_id % 10 = 0),
v as (
  select track, frame, query_time_s, rank, (r % 3)::varchar as matched_flight, 32.10e0 + 0.005e0 * sin(r * 1.7e0) as latitude, 35.20e0 + 0.005e0 * cos(r * 2.3e0) as longitude, r % 40 as inliers, (r % 40) / 40e0 as ratio,
    1.35e0 * ln(1 + r % 40) + 0.45e0 * ln(1 + 2 * (r % 40)) + 1.1e0 * similarity + 1.25e0 * (r % 40) / 40e0 as vis,
    case when 2 * (r % 40) < 12 then 'not_enough_good_matches' when r % 40 < 12 then 'not_enough_inliers' when (r % 40) / 40e0 < 0.25 then 'weak_inlier_ratio' else 'accepted' end as g
  from t where rank <= 5)"""


@query("localize_tracks", _filter_sql(_LOCALIZED_SQL, "v", "frame", "query_time_s", "rank", True, True))
def localize_tracks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("descriptor"))
    lat, lon = F.lit(32.10) + F.lit(0.005) * F.sin(F.col("vec_id") * F.lit(1.7)), F.lit(35.20) + F.lit(0.005) * F.cos(F.col("vec_id") * F.lit(2.3))
    index = e.select(F.col("vec_id").alias("ref_index"), "descriptor", (F.col("vec_id") % 3).cast("string").alias("flight_id"), lat.alias("center_lat"), lon.alias("center_lon"), lat.alias("drone_lat"), lon.alias("drone_lon"))
    queries = e.filter("vec_id % 10 = 0").select((F.col("vec_id") % 4).alias("track"), F.col("vec_id").alias("frame"), F.col("vec_id").cast("double").alias("query_time_s"), F.lit(1.0).alias("query_scale"), "descriptor")
    # the verifier's figures of every retrieved reference, made up from its number
    hits = retrieval.multiscale_topk(queries.select(F.col("frame").alias("query_id"), "query_scale", "descriptor"), index.select("ref_index", "descriptor"), 5)
    inliers = (F.col("ref_index") % 40).cast("long")
    scores = hits.select(
        (F.col("query_id") % 4).alias("track"), F.col("query_id").alias("frame"), "ref_index", F.lit(True).alias("found"), (inliers * 2).alias("good"), inliers.alias("inliers"), (inliers / 40.0).alias("ratio"), F.lit(30.0).alias("mean_distance"),
        F.lit(True).alias("center_inside"), F.lit(True).alias("quad_valid"), F.lit(0.1).alias("quad_area"), F.lit(0.1).alias("ref_area"), F.lit(0.3).alias("ref_width"), F.lit(0.3).alias("ref_height"), F.lit(0.1).alias("query_area"),
    )
    return _r(pipelines.localize(queries, index, scores, 5), _FILTERED)


def _plan(spark, sf_dir):
    p = scored(spark, sf_dir).select("track", "frame", "query_time_s", "latitude", "longitude", "accepted", "confidence", "anchor")
    lat, lon = F.lit(32.10) + F.lit(0.005) * F.sin(F.col("vec_id") * F.lit(1.7)), F.lit(35.20) + F.lit(0.005) * F.cos(F.col("vec_id") * F.lit(2.3))
    reference = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_index"), lat.alias("latitude"), lon.alias("longitude"))
    return p, *pipelines.repair_plan(p, reference, ORIGIN)


@query("repair_plan")
def repair_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[1].select("track", "frame", "seed_trusted", "seed_reason", "tail_rescued", "expected_method", "will_rerun", "path_window_id")


@query("repair_windows")
def repair_windows(spark, sf_dir):
    return _plan(spark, sf_dir)[2]
