"""Scalar operators of the track engine: validity, parsing, scores, gates and labels, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import haversine_m


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_valid_gps(lat, lon) -> Column:
    """Both coordinates there, and not both zero."""
    lat, lon = _c(lat), _c(lon)
    return F.coalesce(~((F.abs(lat) < 1e-12) & (F.abs(lon) < 1e-12)), F.lit(False))


def number_or_null(text) -> Column:
    """A finite number from text, null for anything else."""
    value = F.trim(_c(text).cast("string")).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def integer_or(text, default: int | None = 0) -> Column:
    """The whole part of a number from text, else the default."""
    value = number_or_null(text).cast("long")
    return F.coalesce(value, F.lit(default).cast("long")) if default is not None else value


def is_accepted(flag, loose: bool = True) -> Column:
    """Flags come as text: "1" always counts, "true" and "True" in the loose dialect only. Null is false."""
    text = F.trim(_c(flag).cast("string"))
    return F.coalesce(text.isin("1", "true", "True") if loose else text == "1", F.lit(False))


def timecode(seconds) -> Column:
    """HH:MM:SS.mmm, halves of a millisecond to even; empty for null, bad or negative input."""
    value = number_or_null(seconds)
    ms = F.bround(value * 1000, 0).cast("long")
    text = F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    return F.when(value >= 0, text).otherwise(F.lit(""))


def with_timecodes(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add each timecode column right after the seconds column that it comes from."""
    out = []
    for name in df.columns:
        out.append(F.col(name))
        if name in columns:
            out.append(timecode(name).alias(columns[name]))
    return df.select(*out)


def visual_score(inliers, good, similarity, ratio, mean_distance, center_inside, quad_valid, quad_area) -> Column:
    """How well a candidate matches by sight alone."""
    zero = F.lit(0.0)
    n = lambda x: F.coalesce(_c(x).cast("double"), zero)
    distance = _c(mean_distance).cast("double")
    finite = F.coalesce(F.abs(distance) < float("inf"), F.lit(False))
    score = 1.35 * F.log1p(F.greatest(n(inliers), zero)) + 0.45 * F.log1p(F.greatest(n(good), zero)) + 1.10 * n(similarity)
    score = score + 1.25 * F.greatest(zero, F.least(F.lit(1.0), n(ratio)))
    score = score - F.when(finite, F.greatest(zero, (distance - 35.0) / 80.0)).otherwise(zero)
    score = score - F.when(F.coalesce(_c(center_inside), F.lit(False)), 0.0).otherwise(2.5)
    score = score - F.when(F.coalesce(_c(quad_valid), F.lit(False)), 0.0).otherwise(1.5)
    return score - 1.25 * F.greatest(zero, n(quad_area) - 0.12)


@dataclass(frozen=True)
class Gate:
    """Least and largest values that a visual match must keep to."""

    good: int = 12
    inliers: int = 12
    ratio: float = 0.25
    spread: float = 1.0


def gate_reason(found, good, inliers, ratio, center_inside, quad_valid, ref_area, ref_width, ref_height, query_area, gate: Gate = Gate()) -> Column:
    """The first gate that a candidate fails, or accepted. A null spread never fails."""
    yes = lambda x: F.coalesce(_c(x), F.lit(False))
    scattered = lambda x: F.coalesce(_c(x) > gate.spread, F.lit(False))
    few = lambda x, least: F.coalesce(_c(x), F.lit(0)) < least
    ladder = (
        (~yes(found), "homography_not_found"),
        (few(good, gate.good), "not_enough_good_matches"),
        (few(inliers, gate.inliers), "not_enough_inliers"),
        (few(ratio, gate.ratio), "weak_inlier_ratio"),
        (~yes(center_inside), "projected_center_outside"),
        (~yes(quad_valid), "bad_homography_geometry"),
        (scattered(ref_area), "reference_inliers_scattered_area"),
        (scattered(ref_width), "reference_inliers_scattered_width"),
        (scattered(ref_height), "reference_inliers_scattered_height"),
        (scattered(query_area), "query_inliers_scattered_area"),
    )
    reason = None
    for fails, name in ladder:
        reason = F.when(fails, name) if reason is None else reason.when(fails, name)
    return reason.otherwise("accepted")


def row_confidence(accepted, good, inliers, ratio, similarity, center_inside, geometry_ok, area, width, height, reason) -> Column:
    """Composite confidence of a prediction row; null counts, shares and similarity are 0, null spreads cost nothing."""
    zero = F.lit(0.0)
    n = lambda x: F.coalesce(_c(x).cast("double"), zero)
    yes = lambda x: F.coalesce(_c(x), F.lit(False))
    over = lambda x, free, cost: cost * F.greatest(zero, n(x) - free)
    reason = F.coalesce(_c(reason), F.lit(""))
    score = F.when(yes(accepted), 4.0).otherwise(-1.5)
    score = score + F.least(n(good), F.lit(80.0)) / 12 + F.least(n(inliers), F.lit(60.0)) / 6
    score = score + 5 * F.greatest(zero, F.least(F.lit(1.0), n(ratio))) + 2 * n(similarity)
    score = score + F.when(yes(center_inside), 0.8).otherwise(-1.5) + F.when(yes(geometry_ok), 0.8).otherwise(-1.5)
    score = score - over(area, 0.08, 8.0) - over(width, 0.35, 4.0) - over(height, 0.35, 4.0)
    score = score - F.when(reason.isin("homography_not_found", "not_enough_good_matches", "not_enough_inliers"), 2.0).otherwise(0.0)
    score = score - F.when(reason.isin("weak_inlier_ratio", "bad_homography_geometry"), 1.2).otherwise(0.0)
    return score - F.when(reason.contains("scattered"), 2.0).otherwise(0.0)


def rerun_score(confidence, inliers, good, ratio, accepted) -> Column:
    """Rank of a rerun candidate where only the best is wanted."""
    n = lambda x: F.coalesce(_c(x).cast("double"), F.lit(0.0))
    return n(confidence) + 0.2 * n(inliers) + 0.05 * n(good) + 2 * n(ratio) + F.when(F.coalesce(_c(accepted), F.lit(False)), 5.0).otherwise(0.0)


@dataclass(frozen=True)
class AnchorGate:
    """Thresholds of a row that others may lean on."""

    confidence: float = 6.0
    inliers: int = 10
    good: int = 20
    area: float = 0.12
    width: float = 0.45
    height: float = 0.45


def is_anchor(accepted, lat, lon, confidence, inliers, good, area, width, height, gate: AnchorGate = AnchorGate()) -> Column:
    """Accepted, placed and above all thresholds; null spreads pass."""
    within = lambda x, most: F.coalesce(_c(x) <= most, F.lit(True))
    least = lambda x, low: F.coalesce(_c(x) >= low, F.lit(False))
    ok = F.coalesce(_c(accepted), F.lit(False)) & _c(lat).isNotNull() & _c(lon).isNotNull()
    ok = ok & least(confidence, gate.confidence) & least(inliers, gate.inliers) & least(good, gate.good)
    return ok & within(area, gate.area) & within(width, gate.width) & within(height, gate.height)


@dataclass(frozen=True)
class UpgradeGate:
    confidence: float = 5.0
    inliers: int = 8
    good: int = 15
    ratio: float = 0.18
    #: Whether the candidate must be accepted, and whether a reason it carries must say so.
    accepted: bool = True
    reason_accepted: bool = False


#: Fixed value: the verdict on a candidate that passes all gates.
QUALITY_OK = "candidate_quality_ok"


def upgrade_reason(has_reference, accepted, confidence, inliers, good, ratio, match_reason, gate: UpgradeGate = UpgradeGate()) -> Column:
    """`candidate_quality_ok`, or the first gate that a rerun candidate fails, with the threshold in its name. The names are fixed values."""
    low = lambda x, least: F.coalesce(_c(x).cast("double"), F.lit(0.0)) < least
    yes = lambda x: F.coalesce(_c(x), F.lit(False))
    reason = F.when(~yes(has_reference), "no_reference")
    if gate.accepted:
        reason = reason.when(~yes(accepted), "candidate_not_accepted")
    if gate.reason_accepted:
        said = F.lower(F.trim(F.coalesce(_c(match_reason), F.lit(""))))
        reason = reason.when((said != "") & (said != "accepted"), F.concat(F.lit("candidate_reason_"), said))
    reason = reason.when(low(confidence, gate.confidence), f"candidate_confidence_lt_{gate.confidence:g}")
    reason = reason.when(low(inliers, gate.inliers), f"candidate_inliers_lt_{gate.inliers}")
    reason = reason.when(low(good, gate.good), f"candidate_good_matches_lt_{gate.good}").when(low(ratio, gate.ratio), f"candidate_inlier_ratio_lt_{gate.ratio:g}")
    return reason.otherwise(QUALITY_OK)


def first_of(df: DataFrame, names: list[str], parse=number_or_null) -> Column:
    """Struct (value, source): the first of the named columns, of those that the table has, with a usable value, and its name."""
    tries = [F.when(parse(n).isNotNull(), F.struct(parse(n).alias("value"), F.lit(n).alias("source"))) for n in names if n in df.columns]
    none = F.lit(None).cast("struct<value:double,source:string>")
    return F.coalesce(*tries, none) if tries else none


def first_text(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that holds something other than nothing, none or nan."""
    there = lambda n: F.when(~F.lower(F.trim(n)).isin("", "none", "nan"), F.col(n))
    tries = [there(n) for n in names if n in df.columns]
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


def is_true(flag) -> Column:
    return F.coalesce(F.lower(F.trim(_c(flag).cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def first_pair(*pairs) -> Column:
    """Struct (latitude, longitude) of the first pair that is complete and not (0, 0)."""
    return F.coalesce(*[F.when(has_valid_gps(a, b), F.struct(_c(a).alias("latitude"), _c(b).alias("longitude"))) for a, b in pairs])


def reference_center(center_lat, center_lon, drone_lat, drone_lon) -> Column:
    """The picture's centre if finite and neither coordinate is about 0, else the drone's place if finite, else null."""
    finite = lambda x: F.coalesce(F.abs(_c(x)) < float("inf"), F.lit(False))
    off_zero = lambda x: F.abs(_c(x)) > 1e-12
    pair = lambda a, b: F.struct(_c(a).alias("latitude"), _c(b).alias("longitude"))
    centre = finite(center_lat) & finite(center_lon) & off_zero(center_lat) & off_zero(center_lon)
    return F.when(centre, pair(center_lat, center_lon)).when(finite(drone_lat) & finite(drone_lon), pair(drone_lat, drone_lon))


def source_text(*columns) -> Column:
    return F.lower(F.concat_ws(" ", *[_c(c) for c in columns]))


def mentions(text: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return F.coalesce(found, F.lit(False))


def has_reference(image, flight, frame) -> Column:
    there = lambda c: F.coalesce(F.trim(_c(c).cast("string")) != "", F.lit(False))
    return there(image) | (there(flight) & there(frame))


def cleared_unless(df: DataFrame, keep: Column, columns: list[str]) -> DataFrame:
    """Null the named columns of rows that do not meet the condition."""
    return df.withColumns({c: F.when(F.coalesce(keep, F.lit(False)), F.col(c)) for c in columns if c in df.columns})


#: Weights of the eight scene shares in a scene distance.
SCENE_WEIGHTS = (2.0, 2.5, 1.2, 1.0, 0.8, 0.6, 0.5, 2.0)


def scene_distance(a, b, weights=SCENE_WEIGHTS) -> Column:
    """Weighted mean absolute difference of two arrays of scene shares."""
    w = F.array(*[F.lit(x) for x in weights])
    gaps = F.zip_with(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)), w, lambda d, k: d * k)
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / sum(weights)


def scene_reason(query, reference, sky_gap: float = 0.22, distance: float = 0.22) -> Column:
    """The sky share is compared first (element 0), then the whole scene; both limits may be reached."""
    sky = F.abs(F.get(_c(query), F.lit(0)) - F.get(_c(reference), F.lit(0)))
    return F.when(sky > sky_gap, "sky_horizon_mismatch").when(scene_distance(query, reference) > distance, "scene_signature_mismatch").otherwise("scene_compatible")


def spread(points, width, height) -> Column:
    """Struct of the shares of a picture that a set of points (array of structs x, y) spans; null for fewer than two points."""
    points, width, height = _c(points), _c(width), _c(height)
    axis = lambda k: F.transform(points, lambda p: p[k])
    share = lambda k, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.array_max(axis(k)) - F.array_min(axis(k))) / size))
    w, h = share("x", width), share("y", height)
    return F.when(F.size(points) >= 2, F.struct((w * h).alias("area"), w.alias("width"), h.alias("height")))


def path_key(text) -> Column:
    """A file path as a lookup key: forward slashes, lower case."""
    return F.lower(F.translate(_c(text), "\\", "/"))


def file_stem(path) -> Column:
    return F.regexp_extract(path_key(path), r"([^/]*?)(\.[^./]*)?$", 1)


def id_set(text) -> Column:
    """Array of whole numbers from a list with semicolons or commas; anything else in it is left out."""
    return F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), "[;,]"), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def pair_distance(lat1, lon1, lat2, lon2) -> Column:
    """haversine_m that is null where a pair is incomplete."""
    return haversine_m(lat1, lon1, lat2, lon2)


def region_status(consensus, own, anchor, accepted, distance, near_m: float = 180.0) -> Column:
    """How a row stands to the region that its neighbours agree on."""
    yes = lambda x: F.coalesce(_c(x), F.lit(False))
    consensus, d = _c(consensus), _c(distance)
    status = F.when(consensus.isNull(), "no_consensus_region").when(yes(anchor) & (_c(own) == consensus), "anchor_consistent")
    status = status.when(yes(accepted) & (d <= near_m), "accepted_near_consensus").when(yes(accepted) & (d > near_m), "suspicious_jump_from_consensus")
    return status.when(~yes(accepted), "rejected_inside_consensus_context").otherwise("low_confidence_consensus_context")


def rerun_reason(anchor, context, accepted, own, distance, confidence, far_m: float = 180.0, least: float = 8.0) -> Column:
    """Why a frame is to be run again in its context regions (an array), or why not. The names are fixed values."""
    yes = lambda x: F.coalesce(_c(x), F.lit(False))
    context, (rejected, outside, far, low) = _c(context), RERUN_REASONS
    reason = F.when(yes(anchor), "anchor_keep").when(F.coalesce(F.size(context), F.lit(0)) <= 0, "no_context_skip")
    reason = reason.when(~yes(accepted), rejected).when(_c(own).isNotNull() & ~F.array_contains(context, _c(own)), outside)
    return reason.when(_c(distance) > far_m, far).when(F.coalesce(_c(confidence) < least, F.lit(False)), low).otherwise("accepted_keep")


#: Reasons that send a frame to a rerun.
RERUN_REASONS = ("rejected_or_weak_in_grid_context", "accepted_jump_to_non_context_grid", "accepted_far_from_context_grid", "accepted_low_confidence_in_grid_context")


def nearest_listed_distance(lat, lon, regions, centers) -> Column:
    """Distance of a point to the nearest of the listed regions. `regions`: array of ids; `centers`: map from id to a struct of latitude and
    longitude. Ids that the map lacks are passed over; null for an incomplete point or no known region."""
    centers = _c(centers)
    each = F.transform(_c(regions), lambda r: haversine_m(_c(lat), _c(lon), F.try_element_at(centers, r)["latitude"], F.try_element_at(centers, r)["longitude"]))
    return F.array_min(F.array_compact(each))


def marked_for_rerun(expected_lat, accepted, trusted, initial, mode: str = "all-non-seed") -> Column:
    """Whether a frame is to be run again: never without an expected point; else by mode."""
    yes = lambda x: F.coalesce(_c(x), F.lit(False))
    wanted = {"all-frames": F.lit(True), "all-non-seed": ~yes(trusted), "rejected-only": ~yes(accepted) | ~yes(trusted)}
    if mode not in wanted:
        raise ValueError(f"unknown mode {mode}")
    return _c(expected_lat).isNotNull() & wanted[mode]
