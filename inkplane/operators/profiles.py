"""Thickness along a path: junction spots, interpolation, runs, cuts. A profile has path, ord (0, 1, ...), t, deg."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import let


def _along():
    return Window.partitionBy("path").orderBy("ord")


def junction_spots(profile: DataFrame) -> DataFrame:
    """profile with spot: within half its thickness (rounded up) of a junction point.

    Every junction opens an interval and closes it; the open ones are counted along the path, so no pair of points is made.
    """
    reach = F.ceil(F.col("t") / 2)
    at = profile.where("deg >= 3").select("path", F.explode(F.array(F.struct((F.col("ord") - reach).alias("o"), F.lit(1).alias("d")), F.struct((F.col("ord") + reach + 1).alias("o"), F.lit(-1).alias("d")))).alias("e"))
    marks = at.groupBy("path", F.col("e.o").alias("ord")).agg(F.sum("e.d").alias("d"))
    both = profile.select("path", "ord", "t", "deg", F.lit(0).cast("long").alias("d"), F.lit(1).alias("own")).unionByName(marks.select("path", "ord", F.lit(None).cast("double").alias("t"), F.lit(None).cast("int").alias("deg"), "d", F.lit(0).alias("own")))
    open_ = F.sum("d").over(Window.partitionBy("path").orderBy("ord", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("spot", open_ > 0).where("own = 1").select("path", "ord", "t", "deg", "spot")


def junction_free(spotted: DataFrame) -> DataFrame:
    """Thickness with spots bridged by straight lines between the points beside them; ends take the nearest, a path of spots only stays."""
    good = F.when(~F.col("spot"), F.struct("ord", "t"))
    back = F.last(good, True).over(_along().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first(good, True).over(_along().rowsBetween(Window.currentRow, Window.unboundedFollowing))
    d = spotted.withColumn("p", back).withColumn("q", ahead)
    line = F.col("p.t") + (F.col("q.t") - F.col("p.t")) * (F.col("ord") - F.col("p.ord")) / (F.col("q.ord") - F.col("p.ord"))
    return d.select("path", "ord", F.when(~F.col("spot"), F.col("t")).otherwise(F.coalesce(line, F.col("p.t"), F.col("q.t"), F.col("t"))).alias("t"))


def close_runs(flags: DataFrame, short: int) -> DataFrame:
    """flags (path, ord, on) with runs of less than `short` points that are off turned on, at the ends too."""
    run = F.col("ord") - F.row_number().over(Window.partitionBy("path", "on").orderBy("ord"))
    d = flags.withColumn("run", run)
    n = F.count("*").over(Window.partitionBy("path", "on", "run"))
    return d.select("path", "ord", (F.col("on") | (n < short)).alias("on"))


def trim(flags: DataFrame, free_start: Column, free_end: Column, short: int) -> DataFrame:
    """(path, a, b) left of each path when its free ends are cut back to the first and last point that no arrow covers; covered wholly it goes."""
    closed = close_runs(flags.select("path", "ord", F.col("on")), short)
    ends = flags.groupBy("path").agg(F.max(F.col("ord")).alias("last"), F.first(free_start).alias("fs"), F.first(free_end).alias("fe"))
    kept = closed.groupBy("path").agg(F.min(F.when(~F.col("on"), F.col("ord"))).alias("lo"), F.max(F.when(~F.col("on"), F.col("ord"))).alias("hi"))
    met = kept.join(ends, "path").where("lo is not null")
    return met.select("path", F.when(F.col("fs"), F.col("lo")).otherwise(F.lit(0)).alias("a"), (F.when(F.col("fe"), F.col("hi")).otherwise(F.col("last")) + 1).alias("b"))


def best_cut(profile: DataFrame, ratio: float = 1.3, min_len: int = 3) -> DataFrame:
    """The best place to part each path in two levels: cut (points left of it), score, gain, and whether it is worth it.

    The score weighs the difference of the mean logarithms by both lengths; sides hold min_len median thicknesses at least.
    """
    every = Window.partitionBy("path")
    before = _along().rowsBetween(Window.unboundedPreceding, -1)
    d = profile.withColumn("l", F.log(F.greatest("t", F.lit(1.0))))
    d = d.withColumn("n", F.count("*").over(every)).withColumn("s", F.sum("l").over(every)).withColumn("i", F.col("ord")).withColumn("si", F.sum("l").over(before))
    side = d.groupBy("path").agg(F.ceil(min_len * F.exp(F.median("l"))).alias("m"))
    d = d.join(side, "path").where((F.col("i") >= F.col("m")) & (F.col("n") - F.col("i") >= F.col("m")))
    gap = F.abs(F.col("si") / F.col("i") - (F.col("s") - F.col("si")) / (F.col("n") - F.col("i")))
    d = d.withColumn("gap", gap).withColumn("score", F.round(F.sqrt(F.col("i") * (F.col("n") - F.col("i")) / F.col("n")) * gap, 9))
    best = d.groupBy("path").agg(F.max_by(F.struct("i", "gap", "score"), F.struct("score", -F.col("i"))).alias("b"))
    return best.select("path", F.col("b.i").alias("cut"), F.col("b.score").alias("score"), F.col("b.gap").alias("gap"), (F.col("b.gap") > math.log(ratio)).alias("worth"))


def level_cuts(profile: DataFrame, ratio: float = 1.3, min_len: int = 3) -> DataFrame:
    """(path, cut) of every cut that recursive best cuts make; a path is one group, its length bounded by the sheet."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("ord")
        logs = np.log(np.maximum(pdf["t"].to_numpy(float), 1.0))
        cuts, todo = [], [(0, len(logs))]
        while todo:
            a, b = todo.pop()
            x, n = logs[a:b], b - a
            m = math.ceil(min_len * math.exp(np.median(x))) if n else 0
            i = np.arange(m, n - m + 1)
            i = i[(i > 0) & (i < n)]
            if not len(i):
                continue
            s = np.concatenate([[0], np.cumsum(x)])
            gap = np.abs(s[i] / i - (s[n] - s[i]) / (n - i))
            k = int(np.argmax(np.round(np.sqrt(i * (n - i) / n) * gap, 9)))
            if gap[k] > math.log(ratio):
                cuts.append(a + int(i[k]))
                todo += [(a, cuts[-1]), (cuts[-1], b)]
        return pd.DataFrame({"path": [pdf["path"].iloc[0]] * len(cuts), "cut": cuts}).astype({"path": "int64", "cut": "int64"})

    return profile.select("path", "ord", "t").groupBy("path").applyInPandas(run, "path long, cut long")


def explain_cut(profile: DataFrame, ratio: float = 1.3, min_len: int = 3) -> DataFrame:
    """For each path the best possible cut and its ratio, or why there is none."""
    known = best_cut(profile, ratio, min_len)
    d = profile.select("path").distinct().join(known, "path", "left")
    why = F.when(F.col("cut").isNull(), "too short").when(~F.col("worth"), "levels too close").otherwise("cut")
    return d.select("path", "cut", F.exp("gap").alias("ratio"), why.alias("verdict"))


def branch_cuts(branches: DataFrame, ratio: float = 1.3) -> DataFrame:
    """Branches (path, branch, t, ...) whose mean log thickness differs from that of the rest of their chain by more than the ratio.

    A branch's sum is taken from the chain's sum, so the rest is never gathered.
    """
    b = branches.groupBy("path", "branch").agg(F.sum(F.log(F.greatest("t", F.lit(1.0)))).alias("s"), F.count("*").alias("n"))
    every = Window.partitionBy("path")
    b = b.withColumn("rs", F.sum("s").over(every) - F.col("s")).withColumn("rn", F.sum("n").over(every) - F.col("n"))
    gap = F.abs(F.col("s") / F.col("n") - F.col("rs") / F.col("rn"))
    return b.where("rn > 0").select("path", "branch", gap.alias("gap"), (gap > math.log(ratio)).alias("cut"))


def lower_quartile(values: Column) -> Column:
    """Lower quartile of an array of doubles as the SQL engine has it: fma(lo, 1 - f, hi * f) between neighbours; null of an empty array.

    Products by a half or a quarter are exact, so one rounding and fma's agree but where f is a quarter: there 3 lo is carried in two parts.
    """
    at = (F.size(values) - 1) * F.lit(0.25)
    f = at - F.floor(at)

    def between(e: Column) -> Column:
        lo, hi = e["lo"], e["hi"]
        a, b, c = lo / 2, lo / 4, hi / 4
        s = a + b
        t = s + c
        lost = lambda x, y, r: (x - (r - (r - x))) + (y - (r - x))  # noqa: E731 - what x + y lost when it became r
        once = F.nanvl(t + (lost(a, b, s) + lost(s, c, t)), s + c)
        return F.when(f == 0, lo).when(f == 0.25, once).otherwise(lo * (1 - f) + hi * f)

    pair = F.struct(F.get(values, F.floor(at).cast("int")).alias("lo"), F.get(values, F.ceil(at).cast("int")).alias("hi"))
    return let(pair, between)


def direction_scale(profile: DataFrame) -> DataFrame:
    """Half the lower quartile of thickness, rounded half to even, 2 at least."""
    d = profile.groupBy("path").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return d.select("path", F.greatest(F.lit(2), F.rint(lower_quartile(F.col("ts")) / 2).cast("int")).alias("k"))


def geometric_level(profile: DataFrame) -> DataFrame:
    """Geometric mean thickness, points counting 1 at least."""
    return profile.groupBy("path").agg(F.exp(F.avg(F.log(F.greatest("t", F.lit(1.0))))).alias("level"))


def stroke_width(profile: DataFrame) -> DataFrame:
    """Width to paint a path with: twice the median distance, rounded up, and one."""
    return profile.groupBy("path").agg((F.ceil(2 * F.median("t")) + 1).cast("int").alias("width"))


def extents(points: DataFrame) -> DataFrame:
    """Length and extent of paths of points path, ord, y, x."""
    prev = lambda c: F.lag(c).over(_along())
    d = points.withColumn("step", F.hypot(F.col("y") - prev("y"), F.col("x") - prev("x")))
    return d.groupBy("path").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), (F.max("y") - F.min("y")).alias("eh"), (F.max("x") - F.min("x")).alias("ew"))


def is_frame(extent: DataFrame, h: int, w: int, span: float = 0.9) -> DataFrame:
    """extent with frame: it spans a share of a side of the sheet."""
    return extent.withColumn("frame", (F.col("eh") >= span * h) | (F.col("ew") >= span * w))


def fit_circle(points: DataFrame) -> DataFrame:
    """Least-squares circle of each path by normal equations: sums only, one aggregation. Straight sets give infinite radius and NaN centre."""
    m = points.groupBy("path").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    p = points.join(m, "path").withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my"))
    u, v = F.col("u"), F.col("v")
    s = p.groupBy("path").agg(F.count("*").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), *[F.sum(e).alias(k) for k, e in (("uu", u * u), ("vv", v * v), ("uv", u * v), ("uuu", u * u * u), ("vvv", v * v * v), ("uvv", u * v * v), ("vuu", v * u * u))])
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    a, b = (F.col("uuu") + F.col("uvv")) / 2, (F.col("vvv") + F.col("vuu")) / 2
    flat = F.abs(det) < 1e-9
    cu = F.when(flat, F.lit(float("nan"))).otherwise((a * F.col("vv") - b * F.col("uv")) / F.when(flat, 1.0).otherwise(det))
    cv = F.when(flat, F.lit(float("nan"))).otherwise((b * F.col("uu") - a * F.col("uv")) / F.when(flat, 1.0).otherwise(det))
    s = s.withColumn("cu", cu).withColumn("cv", cv)
    r = F.when(F.isnan("cu"), F.lit(float("inf"))).otherwise(F.sqrt(F.col("cu") * F.col("cu") + F.col("cv") * F.col("cv") + (F.col("uu") + F.col("vv")) / F.col("n")))
    return s.select("path", (F.col("mx") + F.col("cu")).alias("cx"), (F.col("my") + F.col("cv")).alias("cy"), r.alias("r"))
