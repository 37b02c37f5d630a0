"""Operators over the order of a track: nearest flagged rows, gap filling, headings, context ladders, top-k per frame.

A track is partitioned by its key and ordered by (time or row order, tie-breaker); every window is by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.geo import bearing_deg, haversine_m


#: What the anchors around a frame say of its regions.
CONTEXT_REASONS = ("between_same_grid_anchors", "between_different_grid_anchors", "after_previous_grid_anchor", "before_next_grid_anchor", "no_nearby_anchor_context")


def track_window(track: str, order: list[str]):
    return Window.partitionBy(track).orderBy(*order)


def previous_flagged(value: Column, flag: Column, window, steps: int | None = None) -> Column:
    """The value at the nearest earlier flagged row, at most `steps` rows back (any distance if None)."""
    low = Window.unboundedPreceding if steps is None else -steps
    return F.last(F.when(flag, value), ignorenulls=True).over(window.rowsBetween(low, -1))


def next_flagged(value: Column, flag: Column, track: str, order: list[str], steps: int | None = None) -> Column:
    """The value at the nearest later flagged row. Without a bound the track is read backwards: a frame that grows from its start is
    linear in the track, one that shrinks towards its end is evaluated anew at every row."""
    if steps is None:
        return previous_flagged(value, flag, Window.partitionBy(track).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return F.first(F.when(flag, value), ignorenulls=True).over(track_window(track, order).rowsBetween(1, steps))


def with_neighbours(df: DataFrame, flag: Column, columns: list[str], track: str, order: list[str], steps: int | None = None) -> DataFrame:
    """Add prev_ and next_ structs of `columns` from the nearest flagged rows on either side. Rows of equal order come as Spark sorts them."""
    row = F.struct(*columns)
    return df.withColumns({"prev": previous_flagged(row, flag, track_window(track, order), steps), "next": next_flagged(row, flag, track, order, steps)})


def jumps(df: DataFrame, track: str, order: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Placed rows only, with the distance to the placed row before them."""
    w = track_window(track, order)
    placed = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return placed.withColumn("jump_m", haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon)))


def headings(df: DataFrame, track: str, order: list[str], lat: str = "latitude", lon: str = "longitude", moved_m: float = 0.25) -> DataFrame:
    """Heading towards the next row if more than `moved_m` away, else from the one before, else the last good heading, at first 0."""
    w = track_window(track, order)
    la, lo = F.col(lat), F.col(lon)
    n_lat, n_lon, p_lat, p_lon = F.lead(lat).over(w), F.lead(lon).over(w), F.lag(lat).over(w), F.lag(lon).over(w)
    own = F.when(haversine_m(la, lo, n_lat, n_lon) > moved_m, bearing_deg(la, lo, n_lat, n_lon))
    own = own.when(haversine_m(p_lat, p_lon, la, lo) > moved_m, bearing_deg(p_lat, p_lon, la, lo))
    out = df.withColumn("_own", own)
    earlier = F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("heading_deg", F.coalesce("_own", earlier, F.lit(0.0))).drop("_own")


def fill_path(df: DataFrame, kept: Column, track: str, order: list[str], time: str, mode: str = "interpolate", names=("raw_kept", "interpolate_previous_next", "hold_previous", "hold_next", "none"), out=("filtered_latitude", "filtered_longitude", "filtered_method")) -> DataFrame:
    """Coordinates of kept rows as they are, of others by mode: none, hold, or interpolate in time between kept neighbours (else hold)."""
    if mode not in ("none", "hold", "interpolate"):
        raise ValueError(f"unknown fill mode {mode}")
    raw, between, hold_p, hold_n, none = names
    kept = F.coalesce(kept, F.lit(False))
    flag = kept & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    t = F.col(time)
    d = with_neighbours(df.withColumn("_flag", flag).withColumn("_kept", kept), F.col("_flag"), ["latitude", "longitude", time], track, order)
    has_p, has_n = F.col("prev").isNotNull(), F.col("next").isNotNull()
    p_t, n_t = F.col(f"prev.{time}"), F.col(f"next.{time}")
    alpha = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - p_t) / (n_t - p_t)))
    mixing = has_p & has_n & (n_t != p_t)
    method = F.when(F.col("_kept"), raw)
    if mode == "interpolate":
        method = method.when(mixing, between)
    if mode != "none":
        method = method.when(has_p, hold_p).when(has_n, hold_n)
    d = d.withColumn("_method", method.otherwise(none))

    def value(c: str) -> Column:
        p, n, m = F.col(f"prev.{c}"), F.col(f"next.{c}"), F.col("_method")
        return F.when(m == raw, F.col(c)).when(m == between, (1 - alpha) * p + alpha * n).when(m == hold_p, p).when(m == hold_n, n)

    return d.withColumns({out[0]: value("latitude"), out[1]: value("longitude"), out[2]: F.col("_method")}).drop("_flag", "_kept", "_method", "prev", "next")


def expected_path(df: DataFrame, track: str, order: list[str], time: str, trusted: str = "seed_trusted") -> DataFrame:
    """The path that trusted seeds imply for every frame."""
    names = ("seed_anchor", "interpolate_seed_anchors", "hold_previous_seed", "hold_next_seed", "no_seed_path")
    flag = F.col(trusted) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return fill_path(df, flag, track, order, time, "interpolate", names, ("expected_latitude", "expected_longitude", "expected_method"))


def consensus_region(df: DataFrame, anchor: str, region: str, track: str, order: list[str], steps: int = 8) -> DataFrame:
    """Add consensus_region: the region of both neighbouring anchors if they agree, else the row's own if it is an anchor, else the only
    side's. Anchors without a region are passed over."""
    d = with_neighbours(df, F.col(anchor) & F.col(region).isNotNull(), [region], track, order, steps)
    p, n = F.col(f"prev.{region}"), F.col(f"next.{region}")
    has_p, has_n = F.col("prev").isNotNull(), F.col("next").isNotNull()
    found = F.when(has_p & has_n & p.eqNullSafe(n), p).when(F.col(anchor) & F.col(region).isNotNull(), F.col(region))
    found = found.when(has_p & ~has_n, p).when(has_n & ~has_p, n)
    return d.withColumn("consensus_region", found).drop("prev", "next")


def fill_in_region(df: DataFrame, anchor: str, region: str, wanted: str, track: str, order: list[str], time: str, steps: int = 8) -> DataFrame:
    """Add corrected_latitude and _longitude: between the two neighbouring anchors, in time, if both lie in the wanted region."""
    d = with_neighbours(df, F.col(anchor), [region, "latitude", "longitude", time], track, order, steps)
    p_t, n_t = F.col(f"prev.{time}"), F.col(f"next.{time}")
    ok = (F.col(f"prev.{region}") == F.col(wanted)) & (F.col(f"next.{region}") == F.col(wanted)) & (n_t > p_t)
    alpha = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(time) - p_t) / (n_t - p_t)))
    mid = lambda c: F.when(ok, F.col(f"prev.{c}") * (1 - alpha) + F.col(f"next.{c}") * alpha)
    return d.withColumns({"corrected_latitude": mid("latitude"), "corrected_longitude": mid("longitude")}).drop("prev", "next")


def context_regions(df: DataFrame, anchor: str, region: str, track: str, order: list[str], steps: int = 8, most: int = 2, fallback: list[int] = ()) -> DataFrame:
    """Add context_regions (distinct ids, at most `most`) and context_reason from the anchors with a region on either side; `fallback` ids fill up."""
    d = with_neighbours(df, F.col(anchor) & F.col(region).isNotNull(), [region], track, order, steps)
    p, n = F.col(f"prev.{region}"), F.col(f"next.{region}")
    same, different, before, after, none = CONTEXT_REASONS
    reason = F.when(p.isNotNull() & (p == n), same).when(p.isNotNull() & n.isNotNull(), different)
    reason = reason.when(p.isNotNull(), before).when(n.isNotNull(), after).otherwise(none)
    ids = F.array_distinct(F.array_compact(F.concat(F.array(p, n), F.array(*[F.lit(x).cast("int") for x in fallback]) if fallback else F.array().cast("array<int>"))))
    return d.withColumns({"context_regions": F.slice(ids, 1, most), "context_reason": reason}).drop("prev", "next")


def same_cell_support(df: DataFrame, accepted: str, cell: str, track: str, order: list[str], window: int = 8) -> DataFrame:
    """Add same_cell_support: accepted rows of the same cell within `window` rows on either side, the row itself left out; 0 without a cell."""
    w = track_window(track, order).rowsBetween(-window, window)
    near = F.collect_list(F.when(F.col(accepted), F.col(cell))).over(w)  # at most 2 window + 1 values
    own = F.when(F.col(accepted) & F.col(cell).isNotNull(), 1).otherwise(0)
    d = df.withColumn("_near", near)
    support = F.size(F.filter("_near", lambda x: x == F.col(cell))) - own
    return d.withColumn("same_cell_support", F.when(F.col(cell).isNull(), 0).otherwise(support).cast("long")).drop("_near")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def stride_sample(df: DataFrame, every: int, order: list[str], track: str | None = None) -> DataFrame:
    """Every n-th row by order, the first included, within tracks if given."""
    if every < 1:
        raise ValueError("stride must be positive")
    numbered = df.withColumn("_n", F.row_number().over(track_window(track, order))) if track else number_rows(df, order, "_n")
    return numbered.filter((F.col("_n") - 1) % every == 0).drop("_n")


#: Pieces of a table that is numbered as a whole.
PIECES = 256


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 1 by order, nulls first, without bringing them to one task.

    Rows are dealt into pieces of the first key (by approximate quantiles if it is a number, else by value), numbered within their piece,
    and moved on by the size of the pieces before. Only the sizes of the pieces are added up in one place.
    """
    first = order[0]
    if isinstance(df.schema[first].dataType, NumericType):
        cuts = df.agg(F.percentile_approx(F.col(first).cast("double"), [i / PIECES for i in range(1, PIECES)], 10000)).first()[0]
        cuts = F.array(*[F.lit(float(c)) for c in sorted(set(cuts or [0.0]))])
        piece = F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col(first).cast("double"))) + F.when(F.col(first).isNotNull(), 0), F.lit(-1))
    else:
        piece = F.col(first)
    cut = df.withColumn("_piece", piece)
    before = Window.orderBy(F.col("_piece").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_piece").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.select(F.col("_piece").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    joined = cut.join(sizes, F.col("_piece").eqNullSafe(F.col("_of")))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_piece").orderBy(*order))
    return joined.select(*df.columns, number.cast("long").alias(name))
