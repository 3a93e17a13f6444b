"""Histograms, thresholds and densities of weighted levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gray(rgb: DataFrame) -> DataFrame:
    """Gray as the smallest channel: any ink is dark in one of them."""
    return rgb.select("sheet_id", "y", "x", F.least("r", "g", "b").alias("v"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(sheet_id, threshold): the level that parts the histogram with most variance between; ties to the lowest."""
    hist = pixels.groupBy("sheet_id", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("sheet_id").orderBy("v")
    every = Window.partitionBy("sheet_id")
    h = hist.select("sheet_id", "v", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * F.col("v")).over(w).alias("s0"), F.sum("n").over(every).alias("n"), F.sum(F.col("n") * F.col("v")).over(every).alias("s"))
    n1, gap = F.col("n") - F.col("n0"), F.col("s0") * F.col("n") - F.col("s") * F.col("n0")
    var = F.when(n1 > 0, gap.cast("double") * gap / (F.col("n0").cast("double") * n1)).otherwise(F.lit(0.0))
    return h.groupBy("sheet_id").agg(F.max_by("v", F.struct(var, -F.col("v"))).alias("threshold"))


def binarize(pixels: DataFrame) -> DataFrame:
    """Ink 255 at and below the sheet's threshold, 0 above; thresholds are one row a sheet."""
    return pixels.join(otsu(pixels), "sheet_id").select("sheet_id", "y", "x", F.when(F.col("v") <= F.col("threshold"), 255).otherwise(0).alias("v"))


def thickness_hump(profile: DataFrame, top_share: float = 0.06, by: str = "path") -> DataFrame:
    """Mean thickness of the thickest rounded level that holds top_share of the points, else of the most common one (the thinnest of equals)."""
    bins = profile.groupBy(by, F.rint("t").alias("bin")).agg(F.count("*").alias("n"), F.avg("t").alias("mean"))
    bins = bins.withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    big = F.col("n") >= F.lit(top_share) * F.col("total")
    thick = F.max(F.when(big, F.struct("bin", "mean")))
    common = F.max_by("mean", F.struct("n", -F.col("bin")))
    return bins.groupBy(by).agg(F.coalesce(thick["mean"], common).alias("thickness"))


def density(levels: DataFrame, bandwidth: float = 0.05, points: int = 600, by: list[str] | None = None) -> DataFrame:
    """Weighted Gaussian density of log levels on a grid that reaches three bandwidths beyond them, normalised by trapezoids over the level itself.

    levels: lvl, w (and the grouping columns). Result: i, at (a level), dens.
    """
    by = by or []
    l = levels.withColumn("u", F.log("lvl"))
    ends = l.groupBy(*by).agg((F.min("u") - 3 * bandwidth).alias("lo"), (F.max("u") + 3 * bandwidth).alias("hi"))
    grid = ends.select(*by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    grid = grid.select(*by, "i", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("g"))
    met = grid.join(l, by) if by else l.crossJoin(F.broadcast(grid))  # `points` rows
    z = (F.col("g") - F.col("u")) / bandwidth
    raw = met.groupBy(*by, "i", "g").agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("raw")).withColumn("at", F.exp("g"))
    w = Window.partitionBy(*by).orderBy("i")
    area = raw.withColumn("part", (F.col("raw") + F.lag("raw").over(w)) / 2 * (F.col("at") - F.lag("at").over(w)))
    return area.withColumn("total", F.sum("part").over(Window.partitionBy(*by))).select(*by, "i", "at", (F.col("raw") / F.col("total")).alias("dens"))


def peaks(dens: DataFrame, prominence: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Local maxima with their prominence and whether it is at least a share of the highest one.

    A peak's prominence is its height over the higher of the two lowest points on the way to higher ground (or the edge).
    """
    by = by or []
    w = Window.partitionBy(*by).orderBy("i")
    d = dens.withColumn("up", F.lag("dens").over(w)).withColumn("down", F.lead("dens").over(w))
    tops = d.where((F.col("dens") > F.col("up")) & (F.col("dens") > F.col("down"))).select(*by, "i", "at", "dens")
    whole = dens.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "dens"))).alias("line"))  # a row a density, of as many points
    met = tops.join(whole, by) if by else tops.crossJoin(F.broadcast(whole))
    low = lambda side: F.aggregate(
        side, F.struct(F.col("dens").alias("low"), F.lit(False).alias("done")),
        lambda s, p: F.when(s["done"] | (p["dens"] > F.col("dens")), F.struct(s["low"].alias("low"), F.lit(True).alias("done"))).otherwise(F.struct(F.least(s["low"], p["dens"]).alias("low"), F.lit(False).alias("done"))),
    )["low"]
    left = F.reverse(F.filter("line", lambda p: p["i"] < F.col("i")))
    right = F.filter("line", lambda p: p["i"] > F.col("i"))
    p = met.withColumn("prominence", F.col("dens") - F.greatest(low(left), low(right))).drop("line")
    return p.withColumn("significant", F.col("prominence") >= F.lit(prominence) * F.max("dens").over(Window.partitionBy(*by)))


def valleys(dens: DataFrame, tops: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lowest point between each significant peak and the next one: valley_at, valley_dens, from left to right."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("i")
    gaps = tops.where("significant").select(*by, F.col("i").alias("i0"), F.lead("i").over(w).alias("i1")).where("i1 is not null")
    met = dens.join(gaps, by) if by else dens.join(F.broadcast(gaps))
    met = met.where("i > i0 and i < i1")
    return met.groupBy(*by, "i0", "i1").agg(F.min_by("at", F.struct("dens", "i")).alias("valley_at"), F.min("dens").alias("valley_dens"))


def threshold(tops: DataFrame, lows: DataFrame, t_c: float) -> DataFrame:
    """(peak, threshold): the significant peak nearest to a thickness, and the valley just below it; null without one."""
    near = tops.where("significant").agg(F.min_by(F.struct("i", "at"), F.struct(F.abs(F.col("at") - t_c), "i")).alias("p")).select("p.i", F.col("p.at").alias("peak"))
    return near.join(lows, near["i"] == lows["i1"], "left").select("peak", F.col("valley_at").alias("threshold"))


def hump_masses(levels: DataFrame, lows: DataFrame) -> DataFrame:
    """(hump, mass): share of the weight between valleys, humps from the thinnest; lows are few and go to every task."""
    cuts = lows.agg(F.array_sort(F.collect_list("valley_at")).alias("cuts"))
    h = levels.crossJoin(F.broadcast(cuts)).withColumn("hump", F.size(F.filter("cuts", lambda c: c <= F.col("lvl"))))
    m = h.groupBy("hump").agg(F.sum("w").alias("mass"))
    return m.withColumn("mass", F.col("mass") / F.sum("mass").over(Window.partitionBy()))


def weighted_median(values: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Smallest value at which the weight up to it reaches half."""
    v = values.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*by).orderBy(value)
    v = v.withColumn("_c", F.sum("_w").over(w)).withColumn("_t", F.sum("_w").over(Window.partitionBy(*by)))
    return v.where(F.col("_c") >= F.col("_t") / 2).groupBy(*by).agg(F.min(value).alias("median"))


def two_medians(values: DataFrame, value: str, weight: str, by: list[str], rounds: int = 20) -> DataFrame:
    """(low, high, threshold) of weighted values: from Otsu's cut, the middle of the weighted medians of both sides is the next cut, until it stays.

    A group's distinct values are one sorted array, folded in the JVM; a group of one value has nothing to part, and nulls.
    """
    v = values.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    lists = v.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col("w").cast("double").alias("w")))).alias("vs"))
    start = weighted_otsu(values, value, weight, by).select(*by, F.col("threshold").cast("double").alias("cut"))

    def median(part: Column) -> Column:
        total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x["w"])
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("m"))
        step = lambda half: lambda s, x: F.struct((s["s"] + x["w"]).alias("s"), F.when(s["m"].isNull() & (s["s"] + x["w"] >= half), x["v"]).otherwise(s["m"]).alias("m"))
        return F.get(F.transform(F.array(total / 2), lambda half: F.aggregate(part, zero, step(half))["m"]), F.lit(0))

    def cut(c: Column) -> Column:
        low, high = median(F.filter("vs", lambda x: x["v"] <= c)), median(F.filter("vs", lambda x: x["v"] > c))
        return F.struct(F.coalesce(low, high).alias("low"), F.coalesce(high, low).alias("high"))

    first = F.struct(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.coalesce("cut", F.element_at("vs", -1)["v"]).alias("cut"), F.lit(False).alias("done"))

    def step(s, _):
        pair = F.get(F.transform(F.array(s["cut"]), cut), F.lit(0))
        new = F.get(F.transform(F.array(pair), lambda p: F.struct(p["low"].alias("low"), p["high"].alias("high"), ((p["low"] + p["high"]) / 2).alias("cut"), ((p["low"] + p["high"]) / 2 == s["cut"]).alias("done"))), F.lit(0))
        return F.when(s["done"], s).otherwise(new)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step)
    d = lists.join(start, by, "left").withColumn("end", F.when(F.col("cut").isNotNull(), end))
    return d.select(*by, F.col("end.low").alias("low"), F.col("end.high").alias("high"), F.col("end.cut").alias("threshold"))


def weighted_otsu(values: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """(threshold, between): cut of weighted values with most variance between, the lower of equals; a value at the cut is below."""
    v = values.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    w, every = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    m = F.col("_w") * F.col(value)
    v = v.select(*by, value, F.sum("_w").over(w).alias("w0"), F.sum(m).over(w).alias("m0"), F.sum("_w").over(every).alias("w"), F.sum(m).over(every).alias("m"), F.lead(value).over(w).alias("next"))
    w1 = F.col("w") - F.col("w0")
    between = F.col("w0") * w1 / (F.col("w") * F.col("w")) * F.pow(F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / w1, 2)
    return v.where("next is not null").withColumn("b", between).groupBy(*by).agg(F.max_by(value, F.struct(F.round("b", 9), -F.col(value))).alias("threshold"), F.max("b").alias("between"))


def mad(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median and 1.4826 times the median distance from it."""
    m = values.withColumn("_m", F.median(value).over(Window.partitionBy(*by)))
    return m.groupBy(*by).agg(F.first("_m").alias("median"), (F.median(F.abs(F.col(value) - F.col("_m"))) * 1.4826).alias("mad"))
