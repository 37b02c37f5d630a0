"""Repair of noisy tracks: ordered sweeps, clusters, components of seeds, tail rescue, path windows.

Sweeps change flags while they run from left to right, so that a row sees what was rejected before it in the same sweep;
they run within one group a track. Pairs are joins over all tracks at once; of a track's pairs only forests meet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType

from .joins import pairs_in_track, written
from .track import _distance


def _gap(a, b) -> float | None:
    """Distance of two rows (dicts with latitude and longitude), null if either is missing."""
    if a is None or b is None or a["latitude"] is None or b["latitude"] is None or a["longitude"] is None or b["longitude"] is None:
        return None
    return _distance(a["latitude"], a["longitude"], b["latitude"], b["longitude"])


def _speed(a, b) -> float | None:
    d = _gap(a, b)
    if d is None:
        return None
    t = abs(b["query_time_s"] - a["query_time_s"])
    return d / t if t > 1e-6 else None


def _near(rows: list[dict], i: int, way: int, steps: int | None, flag: str) -> dict | None:
    """The nearest row in one direction, at most `steps` away, that still carries the flag and has coordinates."""
    j = i + way
    while 0 <= j < len(rows) and (steps is None or abs(j - i) <= steps):
        r = rows[j]
        if r[flag] and r["latitude"] is not None and r["longitude"] is not None:
            return r
        j += way
    return None


#: Rows that are sent on together.
_SENT = 4096


def _grouped(df: DataFrame, track: str, order: list[str], columns: list[str], result: str, work) -> DataFrame:
    """Run `work` on the ordered rows (dicts, NaN as None) of each track; it returns rows with the result columns. Tracks come one after the
    other as Spark sorts them, so that a task holds one."""
    import pyarrow as pa

    kept = [f for f in df.schema.fields if f.name in (track, *columns)]
    names = [f.name for f in kept]
    new = [x for x in result.split(", ") if x.split()[0] not in names]
    added = {x.split()[0]: {"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}[x.split()[1]] for x in new}
    thin = df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, FractionalType) and not isinstance(f.dataType, DecimalType) else F.col(f.name) for f in kept])

    def run(batches):
        rows, out, types = [], [], dict(added)

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], types[n]) for n in (*names, *added)], [*names, *added])

        for batch in batches:
            types |= dict(zip(names, batch.schema.types))
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(names, values))
                if rows and row[track] != rows[-1][track]:
                    out += work(rows)
                    rows = []
                    if len(out) >= _SENT:
                        yield packed()
                        out = []
                rows.append(row)
        if rows:
            out += work(rows)
        if out:
            yield packed()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return thin.repartition(track).sortWithinPartitions(track, *order).mapInArrow(run, ", ".join([kinds, *new]))


@dataclass(frozen=True)
class PathRules:
    context: int = 10
    support: int = 8
    far_m: float = 160.0
    bridge_m: float = 120.0
    least_support: int = 1
    keep_confidence: float = 18.0
    sweeps: int = 3
    trusted_cells: frozenset = frozenset()
    banned_cells: frozenset = frozenset()


def _path_verdict(rows: list[dict], i: int, rules: PathRules) -> str | None:
    """Why row i is to be rejected, given the flags as they are now."""
    r = rows[i]
    before, after = _near(rows, i, -1, rules.context, "path_accepted"), _near(rows, i, 1, rules.context, "path_accepted")
    cell = r["cell_id"]
    if rules.trusted_cells and cell not in rules.trusted_cells:
        return "outside_trusted_grid_regions"
    if cell in rules.banned_cells:
        return "inside_banned_grid_region"
    back, ahead = _gap(r, before), _gap(r, after)
    far = [d is not None and d >= rules.far_m for d in (back, ahead)]
    both = before is not None and after is not None
    if both and all(far) and before["cell_id"] is not None and before["cell_id"] == after["cell_id"] and cell is not None and cell != before["cell_id"]:
        return "isolated_grid_teleport_between_same_context"
    if any(far):
        lo, hi = max(0, i - rules.support), min(len(rows), i + rules.support + 1)
        support = sum(1 for j in range(lo, hi) if j != i and rows[j]["path_accepted"] and rows[j]["cell_id"] == cell) if cell is not None else 0
        if support < rules.least_support:
            if both:
                return "far_jump_with_low_same_grid_support"
            if (r["confidence"] or 0.0) < rules.keep_confidence:
                return "one_sided_far_jump_with_low_same_grid_support"
    if both and all(far):
        bridge = _gap(before, after)
        if bridge is not None and bridge <= rules.bridge_m:
            return "far_from_short_bridge_context"
    return None


def sweep_path(df: DataFrame, track: str, order: list[str], rules: PathRules = PathRules()) -> DataFrame:
    """Reject rows of a path that do not fit their neighbours. In: latitude, longitude, confidence, cell_id, path_accepted; out: path_accepted, path_reason."""

    def work(rows):
        for r in rows:
            r["path_accepted"] = bool(r["path_accepted"]) and r["latitude"] is not None and r["longitude"] is not None
            r["path_reason"] = "path_consistent" if r["path_accepted"] else "not_accepted"
        for _ in range(max(1, rules.sweeps)):
            changed = False
            for i, r in enumerate(rows):
                if r["path_accepted"]:
                    why = _path_verdict(rows, i, rules)
                    if why:
                        r["path_accepted"], r["path_reason"], changed = False, why, True
            if not changed:
                break
        return rows

    columns = [*order, "latitude", "longitude", "confidence", "cell_id", "path_accepted"]
    return _grouped(df, track, order, columns, "path_accepted boolean, path_reason string", work)


@dataclass(frozen=True)
class SeedRules:
    context: int = 10
    far_m: float = 160.0
    bridge_m: float = 120.0
    most_mps: float = 45.0
    sweeps: int = 4


def _seed_sweep(rules: SeedRules):
    def verdict(rows, i):
        r = rows[i]
        a, b = _near(rows, i, -1, rules.context, "seed_trusted"), _near(rows, i, 1, rules.context, "seed_trusted")
        if a is None or b is None:
            return None
        bridge, bridge_speed = _gap(a, b), _speed(a, b)
        calm = (bridge is not None and bridge <= rules.bridge_m) or (bridge_speed is not None and bridge_speed <= rules.most_mps)
        if calm and all(d is not None and d >= rules.far_m for d in (_gap(a, r), _gap(r, b))):
            return "seed_rejected_isolated_teleport_between_reasonable_neighbors"
        if all(v is not None and v >= rules.most_mps for v in (_speed(a, r), _speed(r, b))):
            return "seed_rejected_speed_impossible_between_neighbors"
        return None

    def work(rows):
        for r in rows:
            r["seed_trusted"] = bool(r["seed_trusted"])
            r["seed_reason"] = "seed_kept" if r["seed_trusted"] else "not_a_seed"
        for _ in range(max(1, rules.sweeps)):
            changed = False
            for i, r in enumerate(rows):
                if r["seed_trusted"]:
                    why = verdict(rows, i)
                    if why:
                        r["seed_trusted"], r["seed_reason"], changed = False, why, True
            if not changed:
                break
        return rows

    return work


def sweep_seeds(df: DataFrame, track: str, order: list[str], rules: SeedRules = SeedRules()) -> DataFrame:
    """Reject seeds between neighbours that rule them out. In: query_time_s, latitude, longitude, seed_trusted; out: seed_trusted, seed_reason."""
    return _grouped(df, track, order, [*order, "query_time_s", "latitude", "longitude", "seed_trusted"], "seed_trusted boolean, seed_reason string", _seed_sweep(rules))


def leader_clusters(anchors: DataFrame, track: str, radius_m: float = 120.0) -> DataFrame:
    """Greedy clusters of anchors, the most confident first (then the earliest): each joins the nearest centroid within the radius, or opens
    a cluster. Numbered from 1 by (size, median confidence, age). In: anchor_id, query_time_s, latitude, longitude, confidence; out: region_id."""

    def work(rows):
        rows.sort(key=lambda r: (-(r["confidence"] or 0.0), r["query_time_s"], r["anchor_id"]))
        regions: list[dict] = []
        for r in rows:
            best, near = None, None
            for region in regions:
                d = _distance(r["latitude"], r["longitude"], region["lat"], region["lon"])
                if near is None or d < near:
                    best, near = region, d
            if best is None or near > radius_m:
                best = {"rows": [], "sum_lat": 0.0, "sum_lon": 0.0, "age": len(regions)}
                regions.append(best)
            best["rows"].append(r)
            n = len(best["rows"])
            best["sum_lat"], best["sum_lon"] = best["sum_lat"] + r["latitude"], best["sum_lon"] + r["longitude"]
            best["lat"], best["lon"] = best["sum_lat"] / n, best["sum_lon"] / n

        def middle(region):
            c = sorted(x["confidence"] or 0.0 for x in region["rows"])
            return (c[(len(c) - 1) // 2] + c[len(c) // 2]) / 2

        regions.sort(key=lambda g: (-len(g["rows"]), -middle(g), g["age"]))
        for number, region in enumerate(regions, 1):
            for r in region["rows"]:
                r["region_id"] = number
        return rows

    placed = anchors.filter("latitude is not null and longitude is not null")
    return _grouped(placed, track, ["anchor_id"], ["anchor_id", "query_time_s", "latitude", "longitude", "confidence"], "region_id int", work)


def regions_of(clustered: DataFrame, track: str) -> DataFrame:
    """One row a region: count, centroid, median confidence, first and last anchor."""
    return clustered.groupBy(track, "region_id").agg(
        F.count(F.lit(1)).alias("anchor_count"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
        F.median("confidence").alias("median_confidence"), F.min("anchor_id").alias("min_frame"), F.max("anchor_id").alias("max_frame"),
    )


#: Nodes of which a task that makes edges keeps a forest at once.
_FOREST = 1 << 18


def _forest(whole: bool):
    """A task's work on edges (track, a, b): (track, node, root) of a forest, the root the least node. `whole`: edges come sorted by track."""
    import pyarrow as pa

    def run(batches):
        roots, n, last, kinds = {}, 0, None, None

        def find(root, x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def packed():
            rows = [(t, x, find(root, x)) for t, root in roots.items() for x in root]
            columns = list(zip(*[r for r in rows if r[1] != r[2]])) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["t", "u", "l"])

        for batch in batches:
            kinds = batch.schema.types
            for t, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if n >= _FOREST and (not whole or t != last):
                    yield packed()
                    roots, n = {}, 0
                last, root = t, roots.setdefault(t, {})
                n -= len(root)
                root.setdefault(a, a)
                root.setdefault(b, b)
                n += len(root)
                a, b = find(root, a), find(root, b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        if roots:
            yield packed()

    return run


def track_components(nodes: DataFrame, edges: DataFrame, track: str, order: str) -> DataFrame:
    """nodes with component: the smallest order of the component within its track. Edges (track, a, b) join nodes. A task that makes edges
    leaves a forest of them, and the forests of a track meet in one task, so that no round is repeated and nothing is written."""
    kinds = ", ".join(f"{n} {edges.schema[c].dataType.simpleString()}" for n, c in (("t", track), ("u", "a"), ("l", "b")))
    known = edges.select(F.col(track).alias("t"), F.col("a").alias("u"), F.col("b").alias("l")).dropna().mapInArrow(_forest(False), kinds)
    label = known.repartition("t").sortWithinPartitions("t").mapInArrow(_forest(True), kinds).select(F.col("t").alias(track), F.col("u").alias(order), F.col("l").alias("component"))
    return nodes.dropna(subset=[track, order]).join(label, [track, order], "left").withColumn("component", F.coalesce("component", order))


def _with_best(members: DataFrame, track: str) -> DataFrame:
    """Add component_size, _total (of the track), and _best and _size of the track's best component: the one that is largest, then most
    confident in sum, then longest in time, then earliest."""
    own, all_of = Window.partitionBy(track, "component"), Window.partitionBy(track)
    best = all_of.orderBy(F.desc("component_size"), F.desc("_sum"), F.desc("_span"), "component")
    found = members.withColumns({
        "component_size": F.count(F.lit(1)).over(own), "_sum": F.sum("confidence").over(own), "_span": F.max("query_time_s").over(own) - F.min("query_time_s").over(own),
    })
    return found.withColumns({"_best": F.first("component").over(best), "_size": F.first("component_size").over(best), "_total": F.count(F.lit(1)).over(all_of)}).drop("_sum", "_span")


def keep_dominant(seeds: DataFrame, track: str, order: str, most_m: float = 180.0, most_mps: float = 25.0, least: int = 4) -> DataFrame:
    """Add component, component_size and seed_trusted: a track with fewer than `least` seeds keeps them all, one whose best component is
    smaller than `least` loses all, else the best component stays."""
    joined = _with_best(track_components(seeds, pairs_in_track(seeds, track, order, most_m, most_mps), track, order), track)
    kept = (F.col("_total") < least) | ((F.col("_size") >= least) & (F.col("component") == F.col("_best")))
    return joined.withColumn("seed_trusted", kept).drop("_best", "_size", "_total")


def keep_supported(seeds: DataFrame, track: str, order: str, most_m: float = 140.0, most_mps: float = 30.0, gap: int = 8, least: int = 4, support: int = 1) -> DataFrame:
    """Add support_count, component and seed_trusted: tracks with fewer than `least` seeds, or a best component below it, lose all; of the
    best component the seeds with at least `support` partners stay."""
    edges = written(pairs_in_track(seeds, track, order, most_m, most_mps, gap).select(track, "a", "b"))
    ends = edges.select(track, F.col("a").alias(order)).unionAll(edges.select(track, F.col("b").alias(order)))
    degree = ends.groupBy(track, order).agg(F.count(F.lit(1)).alias("support_count"))
    joined = _with_best(track_components(seeds, edges, track, order).join(degree, [track, order], "left"), track).withColumn("support_count", F.coalesce("support_count", F.lit(0)))
    kept = (F.col("_total") >= least) & (F.col("_size") >= least) & (F.col("component") == F.col("_best")) & (F.col("support_count") >= support)
    return joined.withColumn("seed_trusted", kept).drop("_best", "_size", "_total", "component_size")


def _tail_rescue(most_m: float = 420.0, most_mps: float = 35.0, gap_s: float = 120.0, least_confidence: float = 8.0, least_points: int = 1):
    def linked(a, b) -> bool:
        d, v = _gap(a, b), _speed(a, b)
        return d is not None and d <= most_m and (v is None or v <= most_mps) and abs(b["query_time_s"] - a["query_time_s"]) <= gap_s

    def work(rows):
        for r in rows:
            r["seed_trusted"], r["tail_rescued"] = bool(r["seed_trusted"]), False
        placed = [r for r in rows if r["initial_seed"] and r["latitude"] is not None and r["longitude"] is not None]
        trusted = [r for r in placed if r["seed_trusted"]]
        if not trusted:
            return rows
        end = max(r["query_time_s"] for r in trusted)
        late = [r for r in placed if not r["seed_trusted"] and r["query_time_s"] > end and (r["confidence"] or 0.0) >= least_confidence]
        late.sort(key=lambda r: r["query_time_s"])
        chain: list[dict] = []
        for r in reversed(late):
            if not chain or linked(r, chain[-1]):
                chain.append(r)
        if len(chain) >= max(1, least_points):
            first = rows.index(chain[-1])
            if linked(_near(rows, first, -1, None, "seed_trusted") or {"latitude": None, "longitude": None}, chain[-1]):
                for r in chain:
                    r["seed_trusted"] = r["tail_rescued"] = True
        return rows

    return work


def rescue_tail(df: DataFrame, track: str, order: list[str], most_m: float = 420.0, most_mps: float = 35.0, gap_s: float = 120.0, least_confidence: float = 8.0, least_points: int = 1) -> DataFrame:
    """Trust a late chain of rejected seeds again that leads back to the last trusted one. In: query_time_s, latitude, longitude,
    confidence, initial_seed, seed_trusted; out: seed_trusted, tail_rescued."""
    columns = [*order, "query_time_s", "latitude", "longitude", "confidence", "initial_seed", "seed_trusted"]
    return _grouped(df, track, order, columns, "seed_trusted boolean, tail_rescued boolean", _tail_rescue(most_m, most_mps, gap_s, least_confidence, least_points))


def rescue_and_sweep(df: DataFrame, track: str, order: list[str]) -> DataFrame:
    """rescue_tail and then sweep_seeds, in one pass over the tracks."""
    columns = [*order, "query_time_s", "latitude", "longitude", "confidence", "initial_seed", "seed_trusted"]
    rescue, sweep = _tail_rescue(), _seed_sweep(SeedRules())
    return _grouped(df, track, order, columns, "seed_trusted boolean, tail_rescued boolean, seed_reason string", lambda rows: sweep(rescue(rows)))


def path_windows(df: DataFrame, track: str, order: list[str], most_frames: int = 45, spacing_m: float = 120.0) -> DataFrame:
    """Cut the frames to run again into windows, by order: a new one at `most_frames`, or more than `spacing_m` from the running mean.
    In: east_m, north_m of the expected point; out: path_window_id, from 1 within the track."""

    def work(rows):
        number, n, sum_x, sum_y = 0, 0, 0.0, 0.0
        for r in rows:
            if not n or n >= most_frames or math.hypot(r["east_m"] - sum_x / n, r["north_m"] - sum_y / n) > spacing_m:
                number, n, sum_x, sum_y = number + 1, 0, 0.0, 0.0
            r["path_window_id"] = number
            n, sum_x, sum_y = n + 1, sum_x + r["east_m"], sum_y + r["north_m"]
        return rows

    placed = df.filter("east_m is not null and north_m is not null")
    return _grouped(placed, track, order, [*order, "east_m", "north_m"], "path_window_id int", work)


def window_stats(windows: DataFrame, track: str, frame: str) -> DataFrame:
    """One row a window: frames, first and last frame, mean place."""
    return windows.groupBy(track, "path_window_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.min(frame).alias("min_query_frame"), F.max(frame).alias("max_query_frame"),
        F.avg("east_m").alias("east_m"), F.avg("north_m").alias("north_m"),
    )
