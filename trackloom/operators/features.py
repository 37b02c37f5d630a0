"""Feature producers as plug-ins, and the parts of them that need no image library.

A producer is a function from a DataFrame with a picture column to the same rows with a result column; it is registered
under a name and made with options. Neural and image-decoding producers are for users to register.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Producer = Callable[[DataFrame, str, str], DataFrame]
_factories: dict[str, Callable[..., Producer]] = {}


def register(name: str, factory: Callable[..., Producer]) -> None:
    """Make a producer known by name; an earlier one of the name is replaced."""
    _factories[name.lower()] = factory


def producer(name: str, **options) -> Producer:
    if name.lower() not in _factories:
        raise ValueError(f"unknown producer {name}; known are {', '.join(sorted(_factories)) or 'none'}")
    return _factories[name.lower()](**options)


def compose(first: Producer, second: Producer) -> Producer:
    """First on the picture column into a temporary one (say a mask applied), second on that."""

    def run(df: DataFrame, picture: str, out: str) -> DataFrame:
        return second(first(df, picture, "_between"), "_between", out).drop("_between")

    return run


def thumbnail(grid: int = 16, bins: int = 8, cells: int = 4) -> Producer:
    """Descriptor of a grey picture given as a struct (width, height, pixels array<double>): cell means and histograms of gradient
    directions by cell, each part centred or normalised, the whole of length one. Null or empty pictures give null."""

    def describe(picture) -> list[float] | None:
        if picture is None or picture["pixels"] is None or not len(picture["pixels"]) or len(picture["pixels"]) != picture["width"] * picture["height"]:
            return None
        image = np.asarray(picture["pixels"], float).reshape(picture["height"], picture["width"])
        rows, cols = (np.linspace(0, n, grid + 1).astype(int) for n in image.shape)
        means = np.array([[image[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:])] for a, b in zip(rows, rows[1:])])
        dy, dx = np.gradient(image) if min(image.shape) > 1 else (np.zeros_like(image), np.zeros_like(image))
        size, angle = np.hypot(dx, dy), np.mod(np.arctan2(dy, dx), np.pi)
        y, x = np.indices(image.shape)
        place = (y * cells // image.shape[0]) * cells + x * cells // image.shape[1]
        which = np.minimum((angle / np.pi * bins).astype(int), bins - 1)
        histogram = np.bincount((place * bins + which).ravel(), size.ravel(), cells * cells * bins)
        flat = (means - means.mean()).ravel()
        parts = [v / (np.linalg.norm(v) + 1e-12) for v in (flat, histogram)]
        whole = np.concatenate(parts)
        length = np.linalg.norm(whole)
        return (whole / length).tolist() if length > 0 else None

    def run(df: DataFrame, picture: str, out: str) -> DataFrame:
        import pandas as pd

        def descriptor(pictures):
            return pd.Series([describe(p) for p in pictures.to_dict("records")])

        descriptor.__annotations__ = {"pictures": pd.DataFrame, "return": pd.Series}  # pandas is imported here only
        return df.withColumn(out, F.pandas_udf("array<float>")(descriptor)(F.col(picture)))

    return run


register("thumbnail", thumbnail)


def gem_pool(patches: Column, p: float = 3.0) -> Column:
    """Signed generalised mean of patch vectors (array<array<double>>), by dimension; null for no patches."""
    power = lambda x: F.signum(x) * F.pow(F.abs(x), p)
    zero = F.transform(F.get(patches, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(patches, zero, lambda acc, v: F.zip_with(acc, v, lambda a, x: a + power(x)))
    mean = F.transform(total, lambda s: s / F.size(patches))
    return F.when(F.size(patches) > 0, F.transform(mean, lambda m: F.signum(m) * F.pow(F.abs(m), 1 / p)))


def unit_length(vector: Column) -> Column:
    """The vector scaled to length one; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(vector)


def class_ids(text: str, names: dict[str, int]) -> list[int]:
    """Class numbers from a list of names and numbers; an unknown name raises."""
    out = []
    for item in (x.strip().lower() for x in text.split(",")):
        if item:
            if not item.isdigit() and item not in names:
                raise ValueError(f"unknown class {item}")
            out.append(int(item) if item.isdigit() else names[item])
    return list(dict.fromkeys(out))


def detection_verdict(class_id, confidence, area, classes: list[int], least_confidence: float, least_area: float, most_area: float) -> Column:
    """Why a detection is masked or not, the first of the gates that it fails."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    verdict = F.when(~c(class_id).isin(classes), "class_not_wanted").when(c(confidence) < least_confidence, "low_confidence")
    return verdict.when(c(area) < least_area, "too_small").when(c(area) > most_area, "too_large").otherwise("accepted")
