"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from . import boxes, graphs, labels, levels, rasters, rules, search, sheets, strokes  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
