"""Geometry on the sphere and in the local plane, as Column expressions (degrees and metres)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; null if any coordinate is null."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def local_xy(lat, lon, origin_lat, origin_lon) -> Column:
    """Struct (east_m, north_m) in the plane that touches the origin, scaled at the mean latitude."""
    lat, lon, origin_lat, origin_lon = map(_c, (lat, lon, origin_lat, origin_lon))
    mean = F.radians((lat + origin_lat) / 2)
    east = F.radians(lon - origin_lon) * EARTH_RADIUS_M * F.cos(mean)
    return F.struct(east.alias("east_m"), (F.radians(lat - origin_lat) * EARTH_RADIUS_M).alias("north_m"))


def from_local_xy(east, north, origin_lat, origin_lon) -> Column:
    """Struct (latitude, longitude): the inverse of local_xy."""
    east, north, origin_lat, origin_lon = map(_c, (east, north, origin_lat, origin_lon))
    lat = origin_lat + F.degrees(north / EARTH_RADIUS_M)
    lon = origin_lon + F.degrees(east / (EARTH_RADIUS_M * F.cos(F.radians((lat + origin_lat) / 2))))
    return F.struct(lat.alias("latitude"), lon.alias("longitude"))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point to the second, in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(turn) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(turn)))
    return F.pmod(angle + 360.0, F.lit(360.0))


def destination_point(lat, lon, bearing, distance) -> Column:
    """Struct (latitude, longitude) reached along a great circle; longitude within [-180, 180)."""
    lat, lon, bearing, distance = map(_c, (lat, lon, bearing, distance))
    arc, course, p1 = distance / EARTH_RADIUS_M, F.radians(bearing), F.radians(lat)
    sine = F.sin(p1) * F.cos(arc) + F.cos(p1) * F.sin(arc) * F.cos(course)
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine))
    turn = F.atan2(F.sin(course) * F.sin(arc) * F.cos(p1), F.cos(arc) - F.sin(p1) * sine)
    return F.struct(F.degrees(F.asin(sine)).alias("latitude"), (F.pmod(lon + F.degrees(turn) + 540.0, F.lit(360.0)) - 180.0).alias("longitude"))


def ground_distance_m(altitude, angle_deg, from_horizontal: bool = True) -> Column:
    """How far ahead a camera tilted by the angle looks at the ground; an angle outside (0, 90) raises."""
    altitude, angle = F.abs(_c(altitude)), _c(angle_deg)
    slope = F.tan(F.radians(angle))
    value = altitude / slope if from_horizontal else altitude * slope
    return F.when((angle > 0) & (angle < 90), value).otherwise(F.raise_error(F.lit("camera angle must lie between 0 and 90 degrees")).cast("double"))


def camera_ground_point(lat, lon, heading, altitude, angle_deg, from_horizontal: bool = True) -> Column:
    """Struct (latitude, longitude) of the ground point in the middle of the picture."""
    return destination_point(lat, lon, heading, ground_distance_m(altitude, angle_deg, from_horizontal))


def pixel_offset_m(x, y, width, height, heading, altitude, angle_deg, hfov_deg, from_horizontal: bool = True) -> Column:
    """Struct (east_m, north_m) of a picture point from the drone. Larger y counts as farther ahead, as in the data model."""
    x, y, width, height, heading, altitude = map(_c, (x, y, width, height, heading, altitude))
    tilt = F.radians(_c(angle_deg))
    slant = F.abs(altitude) / F.greatest(F.sin(tilt) if from_horizontal else F.cos(tilt), F.lit(1e-6))
    across = 2 * slant * F.tan(F.radians(_c(hfov_deg)) / 2)
    along = across * height / F.greatest(width, F.lit(1.0))
    right = (x - width / 2) / F.greatest(width, F.lit(1.0)) * across
    forward = (y - height / 2) / F.greatest(height, F.lit(1.0)) * along
    course = F.radians(heading)
    east = right * F.cos(course) + forward * F.sin(course)
    north = -right * F.sin(course) + forward * F.cos(course)
    return F.struct(east.alias("east_m"), north.alias("north_m"))


def speed_mps(distance, seconds) -> Column:
    """Distance over time; null where the time is not positive."""
    gap = F.abs(_c(seconds))
    return F.when(gap > 1e-6, _c(distance) / gap)


def project_point(h: Column, x, y) -> Column:
    """Struct (x, y) of a point under a 3 x 3 projective matrix given as an array of 9 doubles, row by row; null at infinity."""
    x, y = _c(x), _c(y)
    row = lambda i: F.get(h, F.lit(3 * i)) * x + F.get(h, F.lit(3 * i + 1)) * y + F.get(h, F.lit(3 * i + 2))
    scale = row(2)
    ok = F.abs(scale) > 1e-12
    return F.when(ok, F.struct((row(0) / scale).alias("x"), (row(1) / scale).alias("y")))


def projected_quad(h: Column, width, height) -> Column:
    """Array of the four projected corners, clockwise from the top left."""
    width, height = _c(width), _c(height)
    zero = F.lit(0.0)
    corners = ((zero, zero), (width - 1, zero), (width - 1, height - 1), (zero, height - 1))
    return F.array(*[project_point(h, x, y) for x, y in corners])


def quad_area(quad: Column) -> Column:
    """Area within four corners (shoelace); null if a corner is null."""
    corner = lambda i: F.get(quad, F.lit(i % 4))
    total = sum((corner(i)["x"] * corner(i + 1)["y"] - corner(i + 1)["x"] * corner(i)["y"] for i in range(4)), F.lit(0.0))
    return F.abs(total) / 2


def homography_diagnostics(h, query_width, query_height, ref_width, ref_height, least: float = 0.0005, most: float = 5.0) -> Column:
    """Struct: where the query centre falls in the reference, whether inside, the quad's share of the reference, a verdict and its reason."""
    h, qw, qh, rw, rh = map(_c, (h, query_width, query_height, ref_width, ref_height))
    centre = project_point(h, qw / 2, qh / 2)
    share = quad_area(projected_quad(h, qw, qh)) / F.greatest(rw * rh, F.lit(1.0))
    inside = F.coalesce((centre["x"] >= 0) & (centre["x"] < rw) & (centre["y"] >= 0) & (centre["y"] < rh), F.lit(False))
    valid = F.coalesce(share.between(least, most), F.lit(False))
    reason = F.when(h.isNull(), "homography_not_found").when(centre.isNull() | share.isNull(), "homography_non_finite_projection")
    reason = reason.when(~inside, "projected_center_outside_reference").when(~valid, "homography_quad_area_out_of_range").otherwise("ok")
    return F.struct(
        centre["x"].alias("center_x"), centre["y"].alias("center_y"), inside.alias("center_inside"),
        share.alias("quad_area_frac"), valid.alias("quad_valid"), reason.alias("reason"),
    )


def earth_arc_deg(metres: float) -> float:
    """Degrees of latitude that a distance spans; for bucket sizes."""
    return math.degrees(metres / EARTH_RADIUS_M)
