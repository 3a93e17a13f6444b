"""Small rasters as rows sheet_id, y, x, v: runs, components, distances, one step of thinning. Large sheets go through the kernels instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import connected_components


def runs(ink: DataFrame) -> DataFrame:
    """Horizontal runs sheet_id, y, x0, x1 (half-open) of ink pixels."""
    g = F.col("x") - F.row_number().over(Window.partitionBy("sheet_id", "y").orderBy("x"))
    return ink.withColumn("g", g).groupBy("sheet_id", "y", "g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("g")


def open_lines(ink: DataFrame, least: int) -> DataFrame:
    """Pixels in horizontal runs of a length: an opening by a line."""
    r = runs(ink).where(F.col("x1") - F.col("x0") >= least)
    return r.select("sheet_id", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))


def components(ink: DataFrame, width: int, diagonal: bool = True) -> DataFrame:
    """(sheet_id, y, x, component): runs of touching rows are linked; a component is named by its first pixel, y * width + x.

    Runs of one sheet meet in one join on the row, so its size follows the runs, not the pixels.
    """
    r = runs(ink).withColumn("id", F.col("sheet_id") * width * width + F.col("y") * width + F.col("x0"))
    reach = 1 if diagonal else 0
    p, q = r.alias("p"), r.withColumn("y", F.col("y") - 1).alias("q")
    touch = (F.col("p.x0") < F.col("q.x1") + reach) & (F.col("q.x0") < F.col("p.x1") + reach)
    links = p.join(q, ["sheet_id", "y"]).where(touch).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    found = connected_components(links)
    named = r.join(found, r["id"] == found["node"], "left").withColumn("component", F.coalesce("component", "id") - F.col("sheet_id") * width * width)
    return named.select("sheet_id", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"), "component")


def component_stats(parts: DataFrame) -> DataFrame:
    return parts.groupBy("sheet_id", "component").agg(F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))


def holes(pixels: DataFrame, h: int, w: int) -> DataFrame:
    """(sheet_id, component, area) of background components (4-connected) that do not touch the border."""
    c = components(pixels.where("v = 0").select("sheet_id", "y", "x"), w, diagonal=False)
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == h - 1) | (F.col("x") == w - 1)
    return c.groupBy("sheet_id", "component").agg(F.count("*").alias("area"), F.bool_or(edge).alias("open")).where("not open").drop("open")


def distances(pixels: DataFrame) -> DataFrame:
    """Exact distance of each ink pixel to the nearest background pixel: within columns by windows, then the best column of each row."""
    col = Window.partitionBy("sheet_id", "x").orderBy("y")
    zero = F.when(F.col("v") == 0, F.col("y"))
    up = F.last(zero, True).over(col.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    down = F.first(zero, True).over(col.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    g = F.least(F.col("y") - up, down - F.col("y"))
    d = pixels.withColumn("g", g)
    far = d.where("g is not null").groupBy("sheet_id", "y").agg(F.collect_list(F.struct("x", "g")).alias("row"))
    best = F.array_min(F.transform("row", lambda e: (e["x"] - F.col("x")) * (e["x"] - F.col("x")) + e["g"] * e["g"]))
    return d.where("v > 0").join(far, ["sheet_id", "y"], "left").select("sheet_id", "y", "x", F.sqrt(best).alias("dist"))


def thin_once(ink: DataFrame, first: bool = True) -> DataFrame:
    """Ink left by one sub-iteration of Zhang-Suen thinning; all pixels go at once."""
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    near = ink.select("sheet_id", F.explode(F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(k).alias("k")) for k, (dy, dx) in enumerate(ring)])).alias("n")).select("sheet_id", "n.*")
    has = near.groupBy("sheet_id", "y", "x").agg(F.collect_set("k").alias("ks"))
    d = ink.select("sheet_id", "y", "x").join(has, ["sheet_id", "y", "x"], "left").withColumn("ks", F.coalesce("ks", F.array().cast("array<int>")))
    p = [F.array_contains("ks", k).cast("int") for k in range(8)]
    turns = sum(((1 - p[k]) * p[(k + 1) % 8] for k in range(8)), F.lit(0))
    n = sum(p, F.lit(0))
    a, b = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if first else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
    gone = (n >= 2) & (n <= 6) & (turns == 1) & (a == 0) & (b == 0)
    return d.where(~gone).select("sheet_id", "y", "x")


def fade(pixels: DataFrame, keep: DataFrame) -> DataFrame:
    """Pixels outside a mask faded towards white."""
    k = keep.select("sheet_id", "y", "x", F.lit(True).alias("_k"))
    faded = F.lit(255) - F.floor((255 - F.col("v")) / 4).cast("int")
    return pixels.join(k, ["sheet_id", "y", "x"], "left").select("sheet_id", "y", "x", F.when(F.col("_k"), F.col("v")).otherwise(faded).alias("v"))


def under_mask(pixels: DataFrame, keep: DataFrame) -> DataFrame:
    """Pixels under a mask, white elsewhere."""
    k = keep.select("sheet_id", "y", "x", F.lit(True).alias("_k"))
    return pixels.join(k, ["sheet_id", "y", "x"], "left").select("sheet_id", "y", "x", F.when(F.col("_k"), F.col("v")).otherwise(255).alias("v"))
