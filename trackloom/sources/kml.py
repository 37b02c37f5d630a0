"""Paths as KML text, built by expressions; only the finished document comes to one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_accepted


def xml_text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def fixed(c: Column, places: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value, ties to even, as C's printf does. (Java's rounds the shortest
    decimal that reads back as the number, so that 0.5 of the last place always goes up.)"""
    scale, x = 2.0 * 10**places, F.abs(c)
    f = x - F.floor(x)  # exact, like what follows: pieces of 26 bits times a scale of 19 bits and a power of two
    n = F.rint(f * scale)
    over = (F.floor(f * 2.0**26) / 2.0**26) * scale - n
    rest = f * 2.0**26 - F.floor(f * 2.0**26)
    over = over + F.floor(rest * 2.0**26) / 2.0**52 * scale
    over = over + (rest * 2.0**26 - F.floor(rest * 2.0**26)) / 2.0**52 * scale
    below = F.floor((n - 1) / 2).cast("long")  # for an even n the number before
    up = (n % 2 == 0) | (over > 0) | ((over == 0) & (below % 2 == 1))  # an even n is the nearest number itself, an odd one a tie
    k = below + F.when(up, 1).otherwise(0)
    whole = F.floor(x).cast("long") + F.when(k == 10**places, 1).otherwise(0)
    exact = F.concat(F.when(c < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad((k % 10**places).cast("string"), places, "0"))
    return F.when((x > 0) & (x < 2.0**53), exact).otherwise(F.format_string(f"%.{places}f", c))


def coordinate(lon, lat, alt) -> Column:
    """lon,lat,alt with eight, eight and three decimals; a null altitude is 0."""
    alt = F.coalesce(F.col(alt).cast("double"), F.lit(0.0)) if isinstance(alt, str) else alt
    return F.concat_ws(",", fixed(F.col(lon), 8), fixed(F.col(lat), 8), fixed(alt, 3))


def path_lines(points: DataFrame, path: str, order: list[str], alt: str | None = None) -> DataFrame:
    """One row a path with its coordinates in order, blank-separated; unplaced points are left out, and so are empty paths."""
    placed = points.filter("latitude is not null and longitude is not null")
    c = coordinate("longitude", "latitude", alt if alt else F.lit(0.0))
    lines = placed.groupBy(path).agg(F.sort_array(F.collect_list(F.struct(*order, c.alias("c")))).alias("p"))
    return lines.select(path, F.array_join(F.transform("p", lambda x: x["c"]), " ").alias("coordinates"), F.size("p").cast("long").alias("n_points"))


def placemarks(lines: DataFrame, path: str, start_end: bool = True) -> DataFrame:
    """KML fragments of the paths, with marks at start and end if wanted. A column `layer`, where there is one, is kept."""
    name = xml_text(F.col(path).cast("string"))
    line = F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><LineString><tessellate>1</tessellate><coordinates>"), F.col("coordinates"), F.lit("</coordinates></LineString></Placemark>"))
    ends = F.split("coordinates", " ")
    mark = lambda label, at: F.concat(F.lit("<Placemark><name>"), name, F.lit(f" {label}</name><Point><coordinates>"), F.element_at(ends, at), F.lit("</coordinates></Point></Placemark>"))
    return lines.select(*[c for c in ("layer",) if c in lines.columns], path, (F.concat(line, mark("start", 1), mark("end", -1)) if start_end else line).alias("kml"))


def layers(tables: dict[str, DataFrame], order: list[str], alt: str | None = None) -> DataFrame:
    """(layer, name, coordinates, n_points) of several named tables of points, one line each, in the order given; empty ones are left out."""
    out = None
    for number, (name, points) in enumerate(tables.items()):
        one = path_lines(points.withColumn("name", F.lit(name)), "name", order, alt).select(F.lit(number).alias("layer"), "name", "coordinates", "n_points")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no layers")
    return out


def document(marks: DataFrame, path: str, name: str) -> DataFrame:
    """One row: the whole document, paths in order of their layer, if they have one, and key."""
    place = [c for c in ("layer",) if c in marks.columns]
    body = marks.agg(F.sort_array(F.collect_list(F.struct(*place, path, "kml"))).alias("m")).select(F.array_join(F.transform("m", lambda x: x["kml"]), "\n").alias("b"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>'
    return body.select(F.concat(F.lit(head), xml_text(F.lit(name)), F.lit("</name>\n"), "b", F.lit("\n</Document></kml>\n")).alias("value"))


def write_kml(doc: DataFrame, path: str) -> None:
    doc.coalesce(1).write.mode("overwrite").text(path, lineSep="\n")


def numbered_points(points: DataFrame, order: list[str], accepted: str | None = None) -> DataFrame:
    """Placed (and, where asked for, accepted) points with their number in order, from 1, and a label of three digits or more."""
    from ..operators.windows import number_rows

    placed = points.filter("latitude is not null and longitude is not null")
    if accepted:
        placed = placed.filter(is_accepted(accepted))
    numbered = number_rows(placed, order, "number")
    return numbered.withColumn("label", F.when(F.col("number") < 1000, F.lpad(F.col("number").cast("string"), 3, "0")).otherwise(F.col("number").cast("string")))


def prediction_target(predictions: DataFrame, order: list[str]) -> str:
    """What the first labelled row of a prediction table says was predicted: center or drone, else unknown."""
    said = F.lower(F.trim(F.col("prediction_target").cast("string")))
    row = predictions.filter(said.isin("center", "drone")).orderBy(*order).select(said.alias("t")).first()
    return row["t"] if row else "unknown"


def prediction_points(predictions: DataFrame, order: list[str], stride: int = 1, least_inliers: int | None = None, accepted_only: bool = False, use_filtered: bool = True) -> DataFrame:
    """Points of a prediction table: every n-th row first, then the filters; filtered coordinates where asked for, else the predicted ones."""
    from ..operators.windows import stride_sample

    rows = stride_sample(predictions, stride, order)
    if least_inliers is not None:
        rows = rows.filter(F.coalesce(F.col("homography_inliers"), F.lit(0)) >= least_inliers)
    if accepted_only:
        rows = rows.filter(is_accepted("filter_accepted"))
    names = ("filtered_latitude", "filtered_longitude") if use_filtered and "filtered_latitude" in rows.columns else ("pred_latitude", "pred_longitude")
    return rows.withColumns({"latitude": F.col(names[0]), "longitude": F.col(names[1])}).filter("latitude is not null and longitude is not null")
