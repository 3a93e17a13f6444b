"""Directions, circles and polygons as columns. NaN never matches: Spark orders NaN above all numbers and equal to itself."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def are_coaxial(ax, ay, bx, by, max_angle_deg: float) -> Column:
    """Two outward unit directions that point away from each other within an angle; a zero direction never does."""
    some = ((ax != 0) | (ay != 0)) & ((bx != 0) | (by != 0))
    return some & (ax * bx + ay * by <= -math.cos(math.radians(max_angle_deg)))


def circles_match(xa, ya, ra, xb, yb, rb, tol: float) -> Column:
    """Centres and radii that differ by tol of the mean radius at most; straight lines (NaN centre, infinite radius) never match."""
    finite = ~(F.isnan(xa) | F.isnan(xb) | F.isnan(ra) | F.isnan(rb)) & (ra < float("inf")) & (rb < float("inf"))
    limit = F.lit(tol) * (ra + rb) / 2
    return finite & (F.hypot(xa - xb, ya - yb) <= limit) & (F.abs(ra - rb) <= limit)


def is_arc(radius, rel_err, length, max_err: float = 0.05, min_arc_deg: float = 30.0) -> Column:
    """A finite circle that fits well and spans an angle."""
    return (radius < float("inf")) & ~F.isnan(radius) & (rel_err <= max_err) & (F.degrees(length / radius) >= min_arc_deg)


def unit_direction(dx: Column, dy: Column) -> tuple[Column, Column]:
    n = F.hypot(dx, dy)
    return F.when(n > 0, dx / n).otherwise(F.lit(0.0)), F.when(n > 0, dy / n).otherwise(F.lit(0.0))


def let(value: Column, then) -> Column:
    """then(value), the value being computed once however often `then` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def polygon_area(poly: Column) -> Column:
    """Shoelace area of an array of points; 0 below three points."""

    def area(p: Column) -> Column:
        turned = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
        cross = F.zip_with(p, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        return F.when(F.size(p) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2)

    return let(poly, area)


def clip_half_plane(poly: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    """Points of a polygon on one side of a vertical or horizontal line, with the crossings of its edges."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: p[axis] >= bound if keep_above else p[axis] <= bound

    def crossing(p, q):
        t = (bound - p[axis]) / (q[axis] - p[axis])
        at = (p[other] + t * (q[other] - p[other])).alias(other)
        on = bound.cast("double").alias(axis)
        return F.struct(on, at) if axis == "x" else F.struct(at, on)

    none = F.array().cast("array<struct<x:double,y:double>>")
    edge = lambda p, q: F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(crossing(p, q))).when(inside(q), F.array(crossing(p, q), q)).otherwise(none)
    turned = lambda p: F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
    return let(poly, lambda p: F.when(F.size(p) < 1, none).otherwise(F.flatten(F.zip_with(p, turned(p), edge))))


def clip(poly: Column, x0, y0, x1, y1) -> Column:
    """Intersection of a polygon with a box, side by side; null where nothing of it is left."""
    for axis, bound, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        poly = clip_half_plane(poly, axis, bound, above)
    return let(poly, lambda p: F.when(polygon_area(p) > 0, p))
