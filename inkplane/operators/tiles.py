"""Tiles of sheets, the zones that part a sheet among its tiles, and geometry between scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import let


def _starts(size: Column, tile: int, overlap: float) -> Column:
    """Where tiles start along an axis: a step apart, the last one flush with the edge."""
    step = tile - int(overlap * tile)
    n = F.when(size <= tile, F.lit(1)).otherwise(F.lit(1) + F.ceil((size - tile) / F.lit(step)))
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.least(i * step, F.greatest(F.lit(0), size - tile)).cast("int"))


def grid(sheets: DataFrame, tile: int = 640, overlap: float = 0.2) -> DataFrame:
    """sheet_id, tile_id, x0, y0, x1, y1 of the tiles of sheets with h, w, row by row; a smaller sheet is one clipped tile."""
    if tile <= 0 or not 0 <= overlap < 1:
        raise ValueError("the tile must be positive and the overlap in [0, 1)")
    d = sheets.select("sheet_id", "h", "w", F.posexplode(_starts(F.col("h"), tile, overlap)).alias("row", "y0"), _starts(F.col("w"), tile, overlap).alias("xs"))
    d = d.select("sheet_id", "h", "w", "row", "y0", F.size("xs").alias("cols"), F.posexplode("xs").alias("col", "x0"))
    return d.select("sheet_id", (F.col("row") * F.col("cols") + F.col("col")).alias("tile_id"), "x0", "y0", F.least(F.col("x0") + tile, "w").alias("x1"), F.least(F.col("y0") + tile, "h").alias("y1"))


def _cuts(tiles: Column, lo: str, hi: str, size: Column) -> Column:
    """Of the tiles of a sheet the spans of an axis, each from where to where it rules: cut midway between the end of one and the start of the next."""
    spans = F.array_sort(F.array_distinct(F.transform(tiles, lambda t: F.struct(t[lo].alias("lo"), t[hi].alias("hi")))))

    def ruled(of: Column) -> Column:
        before = lambda s, i: F.coalesce((F.get(of, i - 1)["hi"] + s["lo"]) / 2, F.lit(0.0))
        after = lambda s, i: F.coalesce((s["hi"] + F.get(of, i + 1)["lo"]) / 2, size.cast("double"))
        return F.transform(of, lambda s, i: F.struct(s["lo"].alias("lo"), before(s, i).alias("z0"), after(s, i).alias("z1")))

    return let(spans, ruled)


def zones(tiles: DataFrame, sheets: DataFrame) -> DataFrame:
    """tiles with zx0, zy0, zx1, zy1: half-open zones that part each sheet. A sheet's tiles meet in one row; sheets are merged, as Spark takes them for small."""
    rest = [c for c in tiles.columns if c != "sheet_id"]
    d = tiles.groupBy("sheet_id").agg(F.collect_list(F.struct(*rest)).alias("tiles")).join(sheets.select("sheet_id", "h", "w").distinct().hint("merge"), "sheet_id")
    d = d.select("sheet_id", "tiles", _cuts(F.col("tiles"), "x0", "x1", F.col("w")).alias("xs"), _cuts(F.col("tiles"), "y0", "y1", F.col("h")).alias("ys"))
    own = lambda spans, lo: F.get(F.filter(spans, lambda s: s["lo"] == F.col(f"t.{lo}")), 0)
    d = d.select("sheet_id", F.explode("tiles").alias("t"), "xs", "ys").select("sheet_id", "t", own("xs", "x0").alias("x"), own("ys", "y0").alias("y"))
    return d.select("sheet_id", "t.*", F.col("x.z0").alias("zx0"), F.col("x.z1").alias("zx1"), F.col("y.z0").alias("zy0"), F.col("y.z1").alias("zy1"))


def scale_of(t: Column, target: float, tol: float, max_scale: float) -> Column:
    """Scale that brings a thickness to the target, limited, and 1 within the tolerance; 1 for no thickness."""
    s = F.least(F.lit(target) / t, F.lit(max_scale))
    return F.when(F.abs(s - 1) <= tol, F.lit(1.0)).otherwise(F.coalesce(s, F.lit(1.0)))


def scale_lookup(pixels: DataFrame, target: DataFrame) -> DataFrame:
    """A mask on another scale: each target pixel takes the pixel under it by floor, the last row and column at the edge.

    Each pixel gives the target pixels it lies under, from ceil(y th / h) on; so one row a sheet is joined, and no grid of target pixels is.
    target has sheet_id, h, w (of the pixels), th, tw (wanted).
    """
    met = pixels.join(target.select("sheet_id", "h", "w", "th", "tw").hint("merge"), "sheet_id").where("y >= 0 and y < h and x >= 0 and x < w")
    first = lambda at, size, wanted: F.expr(f"cast((({at}) * cast({wanted} as long) + {size} - 1) div {size} as int)")
    for at, size, wanted, to in (("y", "h", "th", "ty"), ("x", "w", "tw", "tx")):
        a, b = first(at, size, wanted), first(f"{at} + 1", size, wanted) - 1
        met = met.withColumns({"a": a, "b": b}).where("a <= b").withColumn(to, F.explode(F.sequence("a", "b")))
    return met.select("sheet_id", "ty", "tx", "v")


def quarter_turns(pixels: DataFrame, n: int) -> DataFrame:
    """The four quarter turns of square crops of n pixels a side, counter-clockwise."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    d = pixels.select("*", turn)
    last = F.lit(n - 1)
    y = F.when(F.col("k") == 0, F.col("y")).when(F.col("k") == 1, last - F.col("x")).when(F.col("k") == 2, last - F.col("y")).otherwise(F.col("x"))
    x = F.when(F.col("k") == 0, F.col("x")).when(F.col("k") == 1, F.col("y")).when(F.col("k") == 2, last - F.col("x")).otherwise(last - F.col("y"))
    return d.select("sheet_id", "k", y.alias("ry"), x.alias("rx"), "v")


def crop_geometry(views: DataFrame, size: int) -> DataFrame:
    """Where a view's picture lies in a square of `size`: all views of a sheet share the scale of its longest side."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    longest = F.max(F.greatest(w, h)).over(Window.partitionBy("sheet_id"))
    f = F.lit(float(size)) / longest
    cw, ch = F.greatest(F.lit(1), F.rint(w * f).cast("int")), F.greatest(F.lit(1), F.rint(h * f).cast("int"))
    d = views.withColumn("cw", cw).withColumn("ch", ch)
    off = lambda c: ((F.lit(size) - F.col(c)) / 2).cast("int")
    return d.withColumn("ox", off("cw")).withColumn("oy", off("ch"))


def order_views(views: DataFrame) -> DataFrame:
    """views with their number k in the sheet: large to small, then from the top, then from the left, then by seg_id where there is one."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return views.withColumn("k", F.row_number().over(Window.partitionBy("sheet_id").orderBy(area.desc(), "y0", "x0", *(c for c in views.columns if c == "seg_id"))) - 1)
