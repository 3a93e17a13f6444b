"""Axis boxes as columns. A box is a struct x0, y0, x1, y1, half-open where it selects points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(as_col(x0).alias("x0"), as_col(y0).alias("y0"), as_col(x1).alias("x1"), as_col(y1).alias("y1"))


def of_polygon(poly: Column) -> Column:
    """Axis box of an array of points x, y."""
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w.cast("double")) * F.greatest(F.lit(0.0), h.cast("double"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def inside_ratio(a: Column, b: Column) -> Column:
    """Share of a that lies in b."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(F.lit(0.0))


def in_zone(cx: Column, cy: Column, z: Column) -> Column:
    """Whether a point lies in a half-open zone."""
    return (cx >= z["x0"]) & (cx < z["x1"]) & (cy >= z["y0"]) & (cy < z["y1"])


def to_original(b: Column, scale: Column, width: Column, height: Column) -> Column:
    """A box of the working scale on the original: outward to whole pixels, clipped to the sheet."""
    return box(F.greatest(F.lit(0), F.floor(b["x0"] / scale)), F.greatest(F.lit(0), F.floor(b["y0"] / scale)), F.least(width, F.ceil(b["x1"] / scale)), F.least(height, F.ceil(b["y1"] / scale)))
