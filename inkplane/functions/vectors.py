"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least norm that a vector is divided by.
FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector over its length, which counts as FLOOR at least."""
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(FLOOR)))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")
