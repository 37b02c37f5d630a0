"""Joins of the track engine: nearest in time, nearest and within a radius in space, lookups, pairs within a track.

Spatial joins bucket both sides into square cells of the plane around an origin and meet on equal cells, so that no join
compares all rows with all rows. Time joins are a union and two windows, one shuffle by track.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..functions.geo import haversine_m, local_xy, speed_mps
from . import discs


#: Rows of both sides from which a key is read in slices of time, and the number of slices.
LONG_KEY = 1 << 20
TIME_SLICES = 4096


def asof_nearest(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_cols: list[str], order: str) -> DataFrame:
    """Each left row with the right row of its key that is nearest in time; of equally near ones the first in (time, `order`).

    Left rows without any right row get nulls; right rows without a time take no part. Added: `right_cols`, right_<time> and time_gap.

    Both sides are one sequence in time, read forwards for the row before and backwards for the row after, each in one pass. A key of
    more than `LONG_KEY` rows is cut into `TIME_SLICES` slices of its time span, which are read apart; a table of the slices' first and
    last right rows tells each what lies before and behind it.
    """
    packed = F.struct(F.col(right_time).alias("t"), F.col(order).alias("o"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(right_cols)])
    r = right.filter(F.col(right_time).isNotNull()).select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.col(order).alias("_o"), packed.alias("_r"))
    # of right rows with equal times the first stands for all
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_t").orderBy("_o"))).filter("_n = 1").drop("_n", "_o")
    row = F.struct(*[F.col(c) for c in left.columns])
    both = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), row.alias("_l")).unionByName(r, allowMissingColumns=True)
    seconds = F.col("_t").cast("double")
    long = both.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min(seconds).alias("_lo"), F.max(seconds).alias("_hi")).filter(F.col("_n") > LONG_KEY)
    both = both.join(long.withColumnRenamed("_k", "_long"), F.col("_k").eqNullSafe(F.col("_long")), "left")
    share = F.when(F.col("_hi") > F.col("_lo"), (seconds - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    both = both.withColumn("_slice", F.coalesce(F.least(F.floor(share * TIME_SLICES), F.lit(TIME_SLICES - 1)), F.lit(0))).withColumn("_cut", F.col("_n").isNotNull())
    both = both.select("_k", "_t", "_l", "_r", "_slice", "_cut")
    ends = both.filter("_cut").groupBy("_k", "_slice").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_last"), F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_first"))
    slices = Window.partitionBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        F.col("_k").alias("_ek"), F.col("_slice").alias("_es"),
        F.last("_last", ignorenulls=True).over(slices.orderBy("_slice")).alias("_earlier"), F.last("_first", ignorenulls=True).over(slices.orderBy(F.desc("_slice"))).alias("_later"),
    )
    so_far = Window.partitionBy("_k", "_slice").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({
        "_before": F.last("_r", ignorenulls=True).over(so_far.orderBy("_t")),
        "_after": F.last("_r", ignorenulls=True).over(so_far.orderBy(F.desc("_t"))),
    }).filter(F.col("_l").isNotNull())
    both = both.join(ends, F.col("_cut") & F.col("_k").eqNullSafe(F.col("_ek")) & (F.col("_slice") == F.col("_es")), "left")
    both = both.withColumns({"_before": F.coalesce("_before", "_earlier"), "_after": F.coalesce("_after", "_later")})
    back, ahead = F.abs(F.col("_t") - F.col("_before.t")), F.abs(F.col("_after.t") - F.col("_t"))
    best = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    both = both.withColumn("_best", F.when(F.col("_t").isNotNull(), best))
    out = [F.col(f"_l.`{c}`").alias(c) for c in left.columns] + [F.col(f"_best.c{i}").alias(c) for i, c in enumerate(right_cols)]
    return both.select(*out, F.col("_best.t").alias(f"right_{right_time}"), F.abs(F.col("_t") - F.col("_best.t")).alias("time_gap"))


def lookup(left: DataFrame, dim: DataFrame, keys: list[str], values: dict[str, str], order: str) -> DataFrame:
    """Left join on keys with one row a key (the last by `order`); `values` maps dim columns to result columns, and `matched` tells hits."""
    last = dim.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("_v"))
    joined = left.join(last, keys, "left")
    return joined.select(*left.columns, *[F.col(f"_v.`{a}`").alias(b) for a, b in values.items()], F.col("_v").isNotNull().alias("matched"))


def rewrite_from_lookup(left: DataFrame, dim: DataFrame, keys: list[str], values: dict[str, str], order: str) -> DataFrame:
    """Replace columns of matched rows by the dimension's; unmatched rows stay, `matched` tells which."""
    fresh = {a: f"_new_{i}" for i, a in enumerate(values)}
    joined = lookup(left, dim, keys, fresh, order)
    back = {b: fresh[a] for a, b in values.items()}
    cols = [F.when(F.col("matched"), F.col(back[c])).otherwise(F.col(c)).alias(c) if c in back else F.col(c) for c in left.columns]
    return joined.select(*cols, "matched")


def three_key_lookup(left: DataFrame, dim: DataFrame, tries: list[list[str]], value: str, order: str) -> DataFrame:
    """First hit of several keys in order (say full path, base name, flight and frame); adds `value`, null if none hits."""
    out = left
    for i, keys in enumerate(tries):
        one = dim.groupBy(*keys).agg(F.max_by(F.col(value), F.col(order)).alias(f"_v{i}")).dropna(subset=keys)
        out = out.join(one, keys, "left")
    return out.select(*left.columns, F.coalesce(*[F.col(f"_v{i}") for i in range(len(tries))]).alias(value))


#: Centres and grid cells that are sent to every task, at most: some 64 bytes each.
MOST_CENTERS = 1 << 16


def nearest_center(points: DataFrame, centers: DataFrame, id_col: str, most_m: float | None = None) -> DataFrame:
    """Each point (latitude, longitude) with the id of the nearest centre and the distance; ties to the smaller id, beyond `most_m` null.

    Centres are a dimension: up to `MOST_CENTERS` of them go as one array to the points, so that points are not shuffled; more raise, as
    then a join by cells (within_radius) is the way.
    """
    n = centers.limit(MOST_CENTERS + 1).count()
    if n > MOST_CENTERS:
        raise ValueError(f"more than {MOST_CENTERS} centres: use within_radius")
    packed = centers.agg(F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")))).alias("_centers"))
    near = F.array_min(F.transform("_centers", lambda c: F.struct(haversine_m(F.col("latitude"), F.col("longitude"), c["lat"], c["lon"]).alias("d"), c["id"].alias("id"))))
    out = points.join(F.broadcast(packed)).withColumn("_near", F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), near))
    close = F.lit(True) if most_m is None else F.col("_near.d") <= most_m
    return out.select(*points.columns, F.when(close, F.col("_near.id")).alias("center_id"), F.when(close, F.col("_near.d")).alias("center_distance_m"))


def with_local_xy(df: DataFrame, origin: tuple[float, float], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.withColumn("_xy", local_xy(lat, lon, *origin)).select(*df.columns, F.col("_xy.east_m").alias("east_m"), F.col("_xy.north_m").alias("north_m"))


def origin_of(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> tuple[float, float]:
    """Mean latitude and longitude of the finite points; raises for none."""
    row = df.filter(F.abs(F.col(lat)) < float("inf")).filter(F.abs(F.col(lon)) < float("inf")).agg(F.avg(lat), F.avg(lon)).first()
    if row[0] is None:
        raise ValueError("no finite points")
    return float(row[0]), float(row[1])


def grid_cells(df: DataFrame, origin: tuple[float, float], rows: int = 3, cols: int = 5, padding_m: float = 30.0) -> DataFrame:
    """rows x cols cells over the padded bounds of the points, numbered by row from 1; raises if they span nothing, or for more than MOST_CENTERS cells."""
    if rows < 1 or cols < 1:
        raise ValueError("a grid needs a row and a column")
    if rows * cols > MOST_CENTERS:
        raise ValueError(f"a grid has at most {MOST_CENTERS} cells")
    b = with_local_xy(df, origin).agg(F.min("east_m"), F.max("east_m"), F.min("north_m"), F.max("north_m")).first()
    if b[0] is None:
        raise ValueError("no points to lay a grid over")
    x0, x1, y0, y1 = b[0] - padding_m, b[1] + padding_m, b[2] - padding_m, b[3] + padding_m
    if x1 <= x0 or y1 <= y0:
        raise ValueError("the bounds have collapsed")
    w, h = (x1 - x0) / cols, (y1 - y0) / rows
    cells = df.sparkSession.range(rows * cols).select((F.col("id") + 1).cast("int").alias("cell_id"), F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return cells.select(
        "*",
        (F.lit(x0) + F.col("col") * w).alias("x_min_m"), (F.lit(x0) + (F.col("col") + 1) * w).alias("x_max_m"),
        (F.lit(y0) + F.col("row") * h).alias("y_min_m"), (F.lit(y0) + (F.col("row") + 1) * h).alias("y_max_m"),
    )


def cell_of(points: DataFrame, cells: DataFrame, halo_m: float = 1e-9) -> DataFrame:
    """Points with every cell (edges and halo included) that they lie in. Cells are those of grid_cells, MOST_CENTERS at most."""
    c = F.broadcast(cells.select("cell_id", "x_min_m", "x_max_m", "y_min_m", "y_max_m"))
    inside = F.col("east_m").between(F.col("x_min_m") - halo_m, F.col("x_max_m") + halo_m) & F.col("north_m").between(F.col("y_min_m") - halo_m, F.col("y_max_m") + halo_m)
    return points.join(c, inside).select(*points.columns, "cell_id")


def assign_cell(points: DataFrame, cells: DataFrame, id_col: str) -> DataFrame:
    """Each point with the lowest-numbered cell that holds it, null if none."""
    hit = cell_of(points, cells).groupBy(id_col).agg(F.min("cell_id").alias("cell_id"))
    return points.join(hit, id_col, "left")


def halo_counts(points: DataFrame, cells: DataFrame, ladder: list[float], least: int) -> DataFrame:
    """Per cell: points in it, and points within the first halo of the ladder that has at least `least` (else the last), with that halo."""
    widest = max(ladder)
    gap = lambda v, a, b: F.greatest(F.col(a) - F.col(v), F.col(v) - F.col(b), F.lit(0.0))
    c = cells.select("cell_id", "x_min_m", "x_max_m", "y_min_m", "y_max_m")
    near = points.join(F.broadcast(c), F.col("east_m").between(F.col("x_min_m") - widest, F.col("x_max_m") + widest) & F.col("north_m").between(F.col("y_min_m") - widest, F.col("y_max_m") + widest))
    near = near.withColumn("_out", F.greatest(gap("east_m", "x_min_m", "x_max_m"), gap("north_m", "y_min_m", "y_max_m")))
    counted = near.groupBy("cell_id").agg(F.count_if(F.col("_out") <= 1e-9).alias("base_count"), *[F.count_if(F.col("_out") <= h).alias(f"_h{i}") for i, h in enumerate(ladder)])
    return _first_rung(cells.select("cell_id").join(counted, "cell_id", "left"), ["cell_id"], ladder, least, "halo_m", "halo_count", ["base_count"])


def _first_rung(df: DataFrame, keys: list[str], ladder: list[float], least: int, size_name: str, count_name: str, more: list[str] = ()) -> DataFrame:
    n = [F.coalesce(F.col(f"_h{i}"), F.lit(0)) for i in range(len(ladder))]
    size, count = F.lit(float(ladder[-1])), n[-1]
    for i in range(len(ladder) - 2, -1, -1):
        size, count = F.when(n[i] >= least, float(ladder[i])).otherwise(size), F.when(n[i] >= least, n[i]).otherwise(count)
    return df.select(*keys, *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in more], size.alias(size_name), count.cast("long").alias(count_name))


def radius_ladder(start: float, most: float, growth: float = 1.5, clamp: bool = True) -> list[float]:
    """Radii from `start` by `growth` up to `most`: clamped to it, or the last one as grown, which may pass it."""
    out = [start]
    while out[-1] < most:
        grown = out[-1] * growth
        out.append(min(grown, most) if clamp else grown)
    return out


def within_radius(points: DataFrame, targets: DataFrame, radius_m: float, target_id: str) -> DataFrame:
    """Pairs of a point and a target at most `radius_m` apart in the plane, with the distance.

    Targets (east_m, north_m) are put into the nine cells around theirs, of the radius's size; points meet them on their own cell.
    """
    cell = lambda c: F.floor(F.col(c) / radius_m)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    t = targets.select(F.col(target_id).alias("_id"), F.col("east_m").alias("_x"), F.col("north_m").alias("_y")).dropna()
    t = t.withColumn("_a", F.explode(around)).withColumns({"_i": F.floor(F.col("_x") / radius_m) + F.col("_a.i"), "_j": F.floor(F.col("_y") / radius_m) + F.col("_a.j")}).drop("_a")
    p = points.withColumns({"_i": cell("east_m"), "_j": cell("north_m")})
    d = F.hypot(F.col("east_m") - F.col("_x"), F.col("north_m") - F.col("_y"))
    return p.join(t, ["_i", "_j"]).withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m).select(*points.columns, F.col("_id").alias(target_id), "distance_m")


def near_any(points: DataFrame, targets: DataFrame, radius_m: float, target_id: str, point_id: str) -> DataFrame:
    """The points that have a target within the radius."""
    hits = within_radius(points.select(point_id, "east_m", "north_m"), targets, radius_m, target_id).select(point_id).distinct()
    return points.join(hits, point_id, "left_semi")


#: Points, and targets, of a tile that are counted in one piece.
TILE_ROWS = 1 << 19


def _group_key(df: DataFrame, group: str) -> Column:
    """A key that tells groups apart and that Arrow can encode, equal for nulls."""
    kind = df.schema[group].dataType
    return F.col(group) if isinstance(kind, (IntegralType, StringType)) else F.to_json(F.struct(group))


def _places(points: DataFrame, point_id: str) -> DataFrame:
    """The points with finite places, each id once with its least and its greatest place."""
    finite = points.filter((F.abs("east_m") < float("inf")) & (F.abs("north_m") < float("inf")))
    at = F.struct(F.col("east_m").alias("x"), F.col("north_m").alias("y"))
    return finite.groupBy(point_id).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))


def _disc_counts(points: DataFrame, places: DataFrame, targets: DataFrame, group: str, point_id: str, radii: list[float]) -> DataFrame:
    """(_key, _h0, _h1, ...): points near any target of a group, by radius; groups without any are absent. `places` are those of `points`.

    Points lie in tiles, targets in all tiles that they reach. Tiles with many rows are cut into blocks of points times blocks of groups. Ids
    with several places are joined as pairs, so that each counts once.
    """
    widest = max(radii)
    side, reach = 4 * widest, widest * (1 + 1e-6)
    tile = lambda c: F.floor(c / side).cast("long")
    t = targets.withColumn("_key", _group_key(targets, group)).select("_key", F.col("east_m").alias("x"), F.col("north_m").alias("y")).filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    p = places.filter("_lo = _hi").select(F.col("_lo.x").alias("x"), F.col("_lo.y").alias("y")).withColumns({"i": tile(F.col("x")), "j": tile(F.col("y"))})
    for name, c in (("i", "x"), ("j", "y")):
        t = t.withColumn(name, F.explode(F.sequence(tile(F.col(c) - reach), tile(F.col(c) + reach))))
    rows = p.select("i", "j", F.lit(True).alias("is_point"), F.lit(None).cast(t.schema["_key"].dataType).alias("key"), "x", "y").unionByName(t.select("i", "j", F.lit(False).alias("is_point"), F.col("_key").alias("key"), "x", "y"))
    pieces = lambda of: F.ceil(F.count_if(of) / TILE_ROWS).cast("long")
    wide = rows.groupBy("i", "j").agg(pieces(F.col("is_point")).alias("_p"), pieces(~F.col("is_point")).alias("_t")).filter("_p > 1 or _t > 1")
    rows = rows.join(wide, ["i", "j"], "left").withColumns({"_p": F.greatest(F.coalesce("_p", F.lit(1)), F.lit(1)), "_t": F.greatest(F.coalesce("_t", F.lit(1)), F.lit(1))})
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    rows = rows.withColumn("block", F.explode(F.when(F.col("is_point"), F.array(F.pmod(F.xxhash64("x", "y"), F.col("_p")))).otherwise(every(F.col("_p")))))
    rows = rows.withColumn("other", F.explode(F.when(F.col("is_point"), every(F.col("_t"))).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("_t"))))))
    rows = rows.select("i", "j", "block", "other", "is_point", "key", "x", "y").repartition("i", "j", "block", "other").sortWithinPartitions("i", "j", "block", "other", F.desc("is_point"))
    kind = t.schema["_key"].dataType.simpleString()
    counted = rows.mapInArrow(lambda batches: discs.tiles(batches, radii), f"key {kind}, counts array<bigint>")
    # ids with several places
    several = points.join(places.filter("_lo <> _hi").select(F.col(point_id).alias("_p")), F.col(point_id).eqNullSafe(F.col("_p")), "left_semi")
    near = within_radius(several, t.select(F.struct("_key").alias("_k"), F.col("x").alias("east_m"), F.col("y").alias("north_m")), widest, "_k").groupBy("_k", point_id).agg(F.min("distance_m").alias("d"))
    near = near.select(F.col("_k._key").alias("key"), F.array(*[F.when(F.col("d") <= r, 1).otherwise(0).cast("long") for r in radii]).alias("counts"))
    return counted.unionByName(near).groupBy(F.col("key").alias("_key")).agg(*[F.sum(F.col("counts")[i]).alias(f"_h{i}") for i in range(len(radii))])


def count_by_radius(points: DataFrame, targets: DataFrame, group: str, target_id: str, point_id: str, ladder: list[float], least: int, by_rungs: bool = False) -> DataFrame:
    """For each group of targets the points near any of its targets, by the first radius of the ladder with at least `least` (else the last).

    Pairs never become rows (see discs). `by_rungs` counts one radius after the other, each written at once, and takes to the next only the
    groups that need it. Else all is one lazy plan.
    """
    p, t = points.select(point_id, "east_m", "north_m"), targets.select(group, "east_m", "north_m")
    if by_rungs:
        return _count_by_rungs(p, t, group, point_id, ladder, least)
    counted = _disc_counts(p, _places(p, point_id), t, group, point_id, ladder)
    groups = t.select(group).distinct().withColumn("_own", _group_key(t, group))
    return _first_rung(groups.join(counted, F.col("_own").eqNullSafe(F.col("_key")), "left"), [group], ladder, least, "radius_m", "reference_count")


def checkpoint_folder(spark) -> str:
    """The folder of checkpoints, one that all executors share."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            import tempfile

            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="trackloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """The table, written once to the checkpoint folder and read back: later steps neither repeat the work nor carry its plan."""
    import uuid

    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _count_by_rungs(points: DataFrame, targets: DataFrame, group: str, point_id: str, ladder: list[float], least: int) -> DataFrame:
    places = written(_places(points, point_id))
    left, found = targets.select(group).distinct().withColumn("_own", _group_key(targets, group)), None
    for i, radius in enumerate(ladder):
        counted = _disc_counts(points, places, targets, group, point_id, [radius])
        rung = left.join(counted, F.col("_own").eqNullSafe(F.col("_key")), "left").select(group, "_own", F.lit(float(radius)).alias("radius_m"), F.coalesce("_h0", F.lit(0)).cast("long").alias("reference_count"))
        rung = written(rung)
        done = rung if i == len(ladder) - 1 else rung.filter(F.col("reference_count") >= least)
        found = done if found is None else found.unionByName(done)
        left = rung.filter(F.col("reference_count") < least).select(group, "_own")
        if i == len(ladder) - 1 or left.isEmpty():
            break
        targets = targets.join(left.select(F.col("_own").alias("_left")), _group_key(targets, group).eqNullSafe(F.col("_left")), "left_semi")
    return found.drop("_own")


def pairs_in_track(seeds: DataFrame, track: str, order: str, most_m: float, most_mps: float, rank_gap: int | None = None) -> DataFrame:
    """Pairs (i < j by `order`) of one track that a body could have passed: near enough, and slow enough where time passes.

    Columns of seeds: track, order, query_time_s, latitude, longitude. `rank_gap` bounds the gap of ranks among the seeds, and
    the join then meets on rank buckets, so that its size is bounded by the gap and not by the square of the track.
    """
    s = seeds.filter("latitude is not null and longitude is not null")
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy(track).orderBy(order)))
    cols = [F.col(track), *[F.col(c) for c in (order, "rank", "query_time_s", "latitude", "longitude")]]
    side = lambda x: s.select(cols[0], *[c.alias(f"{x}_{n}") for c, n in zip(cols[1:], ("order", "rank", "t", "lat", "lon"))])
    a, b = side("a"), side("b")
    if rank_gap is None:
        # bands of latitude as high as the distance, cut into cells of longitude as wide as it is at the pole-ward end of the band and its
        # neighbours; the second side lies in its own cell, the first one in the nine around it
        size = math.degrees(most_m / 6_371_000.0) * 1.01
        half = math.sin(min(math.pi / 2, most_m / 6_371_000.0 / 2))
        band = lambda x: F.floor(F.col(f"{x}_lat") / size)

        def cells(j):
            """Cells of longitude in band j: as many as fit around the globe."""
            widest = F.cos(F.radians(F.least(F.lit(90.0), (F.greatest(F.abs(j - 1), F.abs(j + 2))) * size)))
            return F.greatest(F.lit(1.0), F.floor(F.lit(360.0) / (F.degrees(2 * F.asin(F.least(F.lit(1.0), half / F.greatest(widest, F.lit(1e-9))))) * 1.01)))

        def cell(j, lon, k=0):
            place = F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * cells(j))
            return F.struct(j.cast("long").alias("j"), F.pmod(place + k, cells(j)).cast("long").alias("i"))

        around = F.array_distinct(F.flatten(F.array(*[F.array(*[cell(band("a") + k, F.col("a_lon"), m) for m in (-1, 0, 1)]) for k in (-1, 0, 1)])))
        a = a.withColumn("_cell", F.explode(around))
        b = b.withColumn("_cell", cell(band("b"), F.col("b_lon")))
    else:
        bucket = lambda x: F.floor(F.col(f"{x}_rank") / rank_gap)
        a = a.withColumn("_cell", F.explode(F.array(bucket("a"), bucket("a") + 1)))
        b = b.withColumn("_cell", bucket("b"))
    joined = a.join(b, [track, "_cell"]).filter("a_rank < b_rank")
    if rank_gap is not None:
        joined = joined.filter(F.col("b_rank") - F.col("a_rank") <= rank_gap)
    d = haversine_m("a_lat", "a_lon", "b_lat", "b_lon")
    joined = joined.withColumn("distance_m", d).withColumn("speed_mps", speed_mps("distance_m", F.col("b_t") - F.col("a_t")))
    ok = (F.col("distance_m") <= most_m) & F.coalesce(F.col("speed_mps") <= most_mps, F.lit(True))
    return joined.filter(ok).select(track, F.col("a_order").alias("a"), F.col("b_order").alias("b"), "distance_m", "speed_mps")


def plan_gate(candidates: DataFrame, plan: DataFrame, frame: str, window: str, extra: Column | None = None) -> DataFrame:
    """Candidates whose frame the plan reruns, and in the planned window where the plan names one. The plan's last row a frame counts."""
    p = plan.groupBy(frame).agg(F.max_by(F.struct(F.col(window).alias("w"), "will_rerun", "expected_latitude", "expected_longitude"), F.col("plan_order")).alias("_p"))
    joined = candidates.join(p, frame).filter(F.col("_p.will_rerun") & (F.col("_p.w").isNull() | (F.col("_p.w") == F.col(window))))
    d = haversine_m("latitude", "longitude", F.col("_p.expected_latitude"), F.col("_p.expected_longitude"))
    joined = joined.withColumn("plan_distance_m", d).drop("_p")
    return joined.filter(extra) if extra is not None else joined


def region_gate(candidates: DataFrame, plan: DataFrame, frame: str, region: str, regions: str) -> DataFrame:
    """Candidates whose (frame, region) the plan approves; the plan lists regions in an array."""
    approved = plan.filter("will_rerun").select(frame, F.explode(regions).alias(region)).distinct()
    return candidates.join(approved, [frame, region], "left_semi")


def before_after(before: DataFrame, after: DataFrame, frame: str, order: str, limit: int | None = None) -> DataFrame:
    """Frames in both tables, the first row a frame of each, in the order of `before`: frame, before and after as structs."""
    first = lambda df, name: df.groupBy(frame).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias(name))
    joined = first(before, "before").join(first(after, "after"), frame).orderBy(F.col(f"before.{order}"))
    return joined.limit(limit) if limit is not None else joined


def hamming_ratio_matches(query: DataFrame, reference: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Two-nearest matching of 64-bit binary descriptors (q_id, bits) x (r_id, bits) of one pair of pictures (pair_id): the nearest
    counts if it is nearer than `ratio` times the second. A pair holds a bounded number of descriptors."""
    q = query.select("pair_id", "q_id", F.col("bits").alias("_q"))
    r = reference.select("pair_id", "r_id", F.col("bits").alias("_r"))
    near = q.join(r, "pair_id").withColumn("distance", F.bit_count(F.col("_q").bitwiseXOR(F.col("_r"))))
    two = near.withColumn("n", F.row_number().over(Window.partitionBy("pair_id", "q_id").orderBy("distance", "r_id"))).filter("n <= 2")
    best = two.groupBy("pair_id", "q_id").agg(F.max(F.when(F.col("n") == 1, F.col("r_id"))).alias("r_id"), F.max(F.when(F.col("n") == 1, F.col("distance"))).alias("distance"), F.max(F.when(F.col("n") == 2, F.col("distance"))).alias("second"))
    return best.filter(F.col("distance") < ratio * F.col("second")).drop("second")
