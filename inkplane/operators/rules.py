"""Cleaning rules over components, segments and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_components(parts: DataFrame, polygons: DataFrame, boxes: DataFrame) -> DataFrame:
    """Components that are text: more than half of their pixels in the union of text polygons, or all of them in one widened box.

    parts: sheet_id, y, x, component; polygons, boxes: sheet_id, id, x0, y0, x1, y1 half-open. A pixel meets the boxes of its grid cell.
    """
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    cell = lambda c: F.floor(F.col(c) / _CELL)
    at = parts.withColumn("gx", cell("x")).withColumn("gy", cell("y"))
    span = lambda lo, hi: F.explode(F.sequence(cell(lo), F.greatest(cell(lo), F.floor((F.col(hi) - 1) / _CELL))))
    dealt = lambda b: b.withColumn("gx", span("x0", "x1")).withColumn("gy", span("y0", "y1"))
    under = lambda b: at.join(dealt(b), ["sheet_id", "gx", "gy"]).where(inside)
    area = parts.groupBy("sheet_id", "component").agg(F.count("*").alias("area"))
    covered = under(polygons).select("sheet_id", "component", "y", "x").distinct().groupBy("sheet_id", "component").agg(F.count("*").alias("n"))
    half = covered.join(area, ["sheet_id", "component"]).where("2 * n > area")
    held = under(boxes).groupBy("sheet_id", "component", "id").agg(F.count("*").alias("n"))
    whole = held.join(area, ["sheet_id", "component"]).where("n = area")
    return half.select("sheet_id", "component").unionByName(whole.select("sheet_id", "component")).distinct()


#: Side of the grid cells in which pixels meet text boxes.
_CELL = 32


def majority_segment(path_pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """(sheet_id, path_id, seg_id): the segment most of a path's pixels lie on, the smallest of equals; 0 where none does."""
    met = path_pixels.join(labels.where("seg_id > 0"), ["sheet_id", "y", "x"]).groupBy("sheet_id", "path_id", "seg_id").agg(F.count("*").alias("n"))
    best = met.groupBy("sheet_id", "path_id").agg(F.max_by("seg_id", F.struct("n", -F.col("seg_id"))).alias("seg_id"))
    return path_pixels.select("sheet_id", "path_id").distinct().join(best, ["sheet_id", "path_id"], "left").select("sheet_id", "path_id", F.coalesce("seg_id", F.lit(0)).alias("seg_id"))


def thin_touches(thin_pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """(sheet_id, seg_id, n_thin): thin paths that touch each segment."""
    met = thin_pixels.join(labels.where("seg_id > 0"), ["sheet_id", "y", "x"]).select("sheet_id", "path_id", "seg_id").distinct()
    return met.groupBy("sheet_id", "seg_id").agg(F.count("*").alias("n_thin"))


def owners(seg_pixels: DataFrame, hull_pixels: DataFrame) -> DataFrame:
    """(sheet_id, seg_id, owner): the hull that holds most of a segment, if more than half; the smallest of equals, else 0."""
    area = seg_pixels.groupBy("sheet_id", "seg_id").agg(F.count("*").alias("area"))
    met = seg_pixels.join(hull_pixels, ["sheet_id", "y", "x"]).groupBy("sheet_id", "seg_id", "hull").agg(F.count("*").alias("n"))
    best = met.groupBy("sheet_id", "seg_id").agg(F.max_by(F.struct("hull", "n"), F.struct("n", -F.col("hull"))).alias("b"))
    return area.join(best, ["sheet_id", "seg_id"], "left").select("sheet_id", "seg_id", F.when(2 * F.col("b.n") > F.col("area"), F.col("b.hull")).otherwise(0).alias("owner"))


def paint_order(hulls: DataFrame) -> DataFrame:
    """Which hull shows at each pixel when small ones are painted first: the largest one over it, the larger id of equals."""
    return hulls.groupBy("sheet_id", "y", "x").agg(F.max_by("hull", F.struct("area", "hull")).alias("hull"))


def with_text(holes: DataFrame, centres: DataFrame) -> DataFrame:
    """(sheet_id, hole, text): whether the centre of a text lies on a pixel of each hole. holes: sheet_id, hole, y, x; centres: sheet_id, y, x."""
    at = centres.select("sheet_id", F.floor(F.col("y")).cast("int").alias("y"), F.floor(F.col("x")).cast("int").alias("x"), F.lit(True).alias("here")).distinct()
    met = holes.join(at, ["sheet_id", "y", "x"], "left")
    return met.groupBy("sheet_id", "hole").agg(F.coalesce(F.bool_or("here"), F.lit(False)).alias("text"))


def tables(cells: DataFrame, min_cells: int = 2) -> DataFrame:
    """Ink components that are tables: enough cells, more than half of them good."""
    t = cells.groupBy("sheet_id", "component").agg(F.count("*").alias("cells"), F.count_if("good").alias("good"))
    return t.where((F.col("cells") >= min_cells) & (2 * F.col("good") > F.col("cells")))


def text_height(ocr_boxes: DataFrame) -> DataFrame:
    """Median of the shorter sides of a sheet's text boxes."""
    return ocr_boxes.groupBy("sheet_id").agg(F.median(F.least("w", "h")).alias("text_h"))


def is_small(w: Column, h: Column, text_h: Column, small_h: float = 1.0) -> Column:
    """Lower than the text; without text nothing is."""
    return F.greatest(w, h) < F.lit(small_h) * F.coalesce(text_h, F.lit(0.0))


def is_view() -> Column:
    return (F.col("free") > 0) & ~F.col("small") & ~F.col("circle") & (F.col("n_thin") > 0)


def is_mark(max_bends: int = 2) -> Column:
    """Inside a view small segments without holes; outside small ones and whatever is no view nor a bent open line with thin lines."""
    bent = (F.col("holes") == 0) & (F.col("bends") > max_bends) & (F.col("n_thin") > 0)
    return F.when(F.col("inside"), F.col("small") & (F.col("holes") == 0)).otherwise(F.col("small") | ~(is_view() | bent))


def circles(points: DataFrame, tol: float = 1.0) -> DataFrame:
    """(seg_id, circle): no point of a segment is farther from the mean radius than tol."""
    by = Window.partitionBy("sheet_id", "seg_id")
    r = points.withColumn("_r", F.hypot(F.col("y") - F.avg("y").over(by), F.col("x") - F.avg("x").over(by)))
    return r.withColumn("_d", F.abs(F.col("_r") - F.avg("_r").over(by))).groupBy("sheet_id", "seg_id").agg((F.max("_d") <= tol).alias("circle"))


def remove(paths: DataFrame, gone: DataFrame) -> DataFrame:
    """Paths but those removed."""
    return paths.join(gone.select("sheet_id", "path_id").distinct(), ["sheet_id", "path_id"], "left_anti")


def view_boxes(segments: DataFrame) -> DataFrame:
    """Bounding box and area of each view's segments."""
    b = segments.groupBy("sheet_id", "view").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return b.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def arrow_cover(path_pixels: DataFrame, mask: DataFrame, sy: float, sx: float) -> DataFrame:
    """path pixels with on: an arrow's mask of another scale lies under them, by floor."""
    m = mask.select("sheet_id", F.col("y").alias("my"), F.col("x").alias("mx"), F.lit(True).alias("on")).distinct()
    d = path_pixels.withColumn("my", F.floor(F.col("y") * sy).cast("int")).withColumn("mx", F.floor(F.col("x") * sx).cast("int"))
    return d.join(m, ["sheet_id", "my", "mx"], "left").withColumn("on", F.coalesce("on", F.lit(False))).drop("my", "mx")
