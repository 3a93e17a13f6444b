"""Detections as tables: duplicates by overlap, zones of tiles, boxes within boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B


def filter_confidence(det: DataFrame, least: float) -> DataFrame:
    return det.where(F.col("conf") >= least)


def suppress(det: DataFrame, threshold: float = 0.3, by: str = "sheet", key: str = "id", cell: float | None = None) -> DataFrame:
    """Of each sheet the detections that overlap none kept before them by more than the threshold, the surest first.

    Only pairs that overlap so much count: they come from the grid. Ties of confidence go by the key. A detection is kept if all
    surer ones that it overlaps are gone; in each round those with no surer one left are kept and what they overlap goes, so the
    rounds follow the longest chain of overlaps and not the number of boxes.
    """
    pairs = overlaps(det, threshold, by, key, cell)
    rank = det.select(by, F.col(key).alias("k"), F.struct((-F.col("conf")).alias("neg"), F.col(key).alias("id")).alias("r"))
    left = lambda c, r: rank.select(by, F.col("k").alias(c), F.col("r").alias(r))
    ranked = pairs.select(by, "a", "b").join(left("a", "ra"), [by, "a"]).join(left("b", "rb"), [by, "b"])
    first, second = F.col("ra") < F.col("rb"), F.struct("a", "b")
    arcs = ranked.select(by, F.when(first, second["a"]).otherwise(second["b"]).alias("over"), F.when(first, second["b"]).otherwise(second["a"]).alias("under"))
    # what one sheet's overlaps leave is settled in its row: arcs are few, each names two boxes
    sheet = arcs.groupBy(by).agg(F.collect_list(F.struct("over", "under")).alias("arcs"))
    names = lambda xs: F.array_distinct(xs)
    start = F.struct(F.col("arcs").alias("open"), F.slice(F.transform("arcs", lambda x: x["under"]), 1, 0).alias("gone"))

    def round_(s, _):
        below = names(F.transform(s["open"], lambda x: x["under"]))
        kept = F.array_except(names(F.transform(s["open"], lambda x: x["over"])), below)
        gone = names(F.transform(F.filter(s["open"], lambda x: F.array_contains(kept, x["over"])), lambda x: x["under"]))
        still = F.filter(s["open"], lambda x: ~F.array_contains(gone, x["over"]) & ~F.array_contains(gone, x["under"]))
        return F.when(F.size(s["open"]) == 0, s).otherwise(F.struct(still.alias("open"), F.concat(s["gone"], gone).alias("gone")))

    gone = sheet.select(by, F.explode(F.aggregate(F.sequence(F.lit(1), F.size("arcs")), start, round_)["gone"]).alias(key))
    return det.select(by, key).join(gone, [by, key], "left_anti")


def _cell(det: DataFrame, by: str, cell: float | None) -> DataFrame:
    """det with the side of its sheet's grid cells: twice the mean longer side of the sheet's boxes, so that few boxes share a cell and none covers many."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    own = det.groupBy(by).agg(F.greatest(F.lit(2.0) * F.avg(side), F.lit(1e-6)).alias("_cell"))
    return det.withColumn("_cell", F.lit(float(cell))) if cell else det.join(own, by)


def _dealt(det: DataFrame, by: str, key: str, cell: float | None) -> DataFrame:
    """by, gx, gy, key, box b, cell: boxes in every grid cell they touch."""
    d = _cell(det.select(by, key, "x0", "y0", "x1", "y1"), by, cell)
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.col("_cell")), F.floor(F.col(hi) / F.col("_cell")))
    d = d.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))
    return d.select(by, "gx", "gy", key, B.box("x0", "y0", "x1", "y1").alias("b"), "_cell")


def _met(det: DataFrame, by: str, key: str, cell: float | None) -> DataFrame:
    """Pairs of different boxes of a sheet that share a cell, each once: in the first one they share."""
    d = _dealt(det, by, key, cell)
    p, q = d.alias("p"), d.drop("_cell").alias("q")
    met = p.join(q, [by, "gx", "gy"]).where(F.col(f"p.{key}") < F.col(f"q.{key}"))
    first = (F.col("gx") == F.floor(F.greatest("p.b.x0", "q.b.x0") / F.col("_cell"))) & (F.col("gy") == F.floor(F.greatest("p.b.y0", "q.b.y0") / F.col("_cell")))
    return met.where(first).select(by, F.col(f"p.{key}").alias("a"), F.col(f"q.{key}").alias("b"), F.col("p.b").alias("ba"), F.col("q.b").alias("bb"))


def overlaps(det: DataFrame, least: float, by: str = "sheet", key: str = "id", cell: float | None = None) -> DataFrame:
    """Pairs (a, b) of a sheet's boxes whose overlap is larger than `least`, with it. Boxes are dealt to the grid cells they touch."""
    score = B.iou(F.col("ba"), F.col("bb"))
    return _met(det, by, key, cell).select(by, "a", "b", score.alias("iou")).where(F.col("iou") > least)


def containers(det: DataFrame, least: float = 0.5, by: str = "sheet", key: str = "id", cell: float | None = None) -> DataFrame:
    """For each box the larger one that holds most of it, if that is more than `least`; ties to the smaller key."""
    met = _met(det, by, key, cell)
    swap = B.area(F.col("ba")) > B.area(F.col("bb"))
    pick = lambda yes, no: F.when(swap, F.col(yes)).otherwise(F.col(no))
    met = met.where(B.area(F.col("ba")) != B.area(F.col("bb"))).select(by, pick("b", "a").alias(key), pick("a", "b").alias("parent"), pick("bb", "ba").alias("small"), pick("ba", "bb").alias("large"))
    met = met.select(by, key, "parent", B.inside_ratio(F.col("small"), F.col("large")).alias("share")).where(F.col("share") > least)
    return met.groupBy(by, key).agg(F.max_by("parent", F.struct("share", -F.col("parent"))).alias("parent"), F.max("share").alias("share"))


def in_own_zone(det: DataFrame, zones: DataFrame, least: float) -> DataFrame:
    """Detections sure enough whose centre lies in the zone of the tile that found them: an object in two tiles counts once.

    det has tile_id and a box in the tile's coordinates; zones has sheet, tile_id, the tile's corner tx, ty and the zone.
    """
    met = filter_confidence(det, least).join(zones, ["sheet", "tile_id"])
    cx, cy = F.col("tx") + (F.col("x0") + F.col("x1")) / 2, F.col("ty") + (F.col("y0") + F.col("y1")) / 2
    return met.where(B.in_zone(cx, cy, F.struct(F.col("zx0").alias("x0"), F.col("zy0").alias("y0"), F.col("zx1").alias("x1"), F.col("zy1").alias("y1"))))


def has_alnum(text: Column) -> Column:
    """Whether a letter or digit of any script stands in a text."""
    return text.rlike(r"[\p{L}\p{N}]")


def project_back(poly: Column, mat: Column) -> Column:
    """Points through an affine map of six numbers a b c / d e f, in float."""
    f = lambda c: c.cast("float")
    return F.transform(poly, lambda p: F.struct(f(mat[0] * p["x"] + mat[1] * p["y"] + mat[2]).alias("x"), f(mat[3] * p["x"] + mat[4] * p["y"] + mat[5]).alias("y")))


def readable(ocr: DataFrame, threshold: float = 0.3) -> DataFrame:
    """OCR results with a letter or digit, duplicates of rotations removed."""
    some = ocr.where(has_alnum(F.col("text"))).withColumn("_b", B.of_polygon(F.col("poly")))
    d = some.select(F.col("sheet_id").alias("sheet"), F.col("det_id").alias("id"), F.col("confidence").alias("conf"), "_b.x0", "_b.y0", "_b.x1", "_b.y1")
    return some.drop("_b").join(suppress(d, threshold).select(F.col("sheet").alias("sheet_id"), F.col("id").alias("det_id")), ["sheet_id", "det_id"], "left_semi")


def ordered(results: DataFrame) -> DataFrame:
    """Results in the order of their inputs: by the argument that names them, then by path."""
    return results.orderBy("source", "path")


def status(results: DataFrame) -> DataFrame:
    """How many inputs failed and how many did not; exit code 1 if any failed."""
    return results.agg(F.count(F.when(F.col("error").isNull(), 1)).alias("ok"), F.count("error").alias("failed"), F.when(F.count("error") > 0, 1).otherwise(0).alias("exit_code"))


def best_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
