"""Lines by their sections: directions along branches and at their ends, ends that continue each other, lines as groups of branches, lines at the edge of a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graphs
from .levels import weighted_median


def tangents(points: DataFrame, k: int = 3) -> DataFrame:
    """points (path, ord, y, x) with the unit direction ty, tx of the chord from k points before to k after each, cut at the ends; 0 of a single point."""
    w = Window.partitionBy("path").orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda c, n: F.coalesce(F.lead(c, n).over(w), F.last(c).over(whole)) - F.coalesce(F.lag(c, n).over(w), F.first(c).over(whole))
    d = points.withColumn("_dy", at("y", k)).withColumn("_dx", at("x", k))
    n = F.greatest(F.hypot("_dy", "_dx"), F.lit(1e-9))
    return d.withColumn("ty", F.col("_dy") / n).withColumn("tx", F.col("_dx") / n).drop("_dy", "_dx")


def off_junctions(points: DataFrame) -> DataFrame:
    """points (path, ord, dist, deg) with clear: not within the distance of an end that is a junction, counted in points."""
    whole = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spot = lambda end: F.when(end("deg").over(whole) >= 3, F.ceil(end("dist").over(whole))).otherwise(0)
    last = F.max("ord").over(Window.partitionBy("path"))
    return points.withColumn("clear", (F.col("ord") >= spot(F.first)) & (last - F.col("ord") >= spot(F.last)))


def end_directions(points: DataFrame, w: int = 6) -> DataFrame:
    """(path, side, dy, dx, err): direction into each end of a branch and its error in degrees.

    points: path, ord (0, 1, ...), y, x, dist. The chord begins dist points from the end and is w points long; a branch too short for
    it is taken whole. Of a single point the direction is 0 and the error 180.
    """
    p = points.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "y", "x", "dist"))).alias("p"))  # a branch of one sheet
    d = p.select("path", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("p")), F.struct(F.lit(1).alias("side"), F.reverse("p").alias("p")))).alias("e")).select("path", "e.*")
    last = F.size("p") - 1
    d = d.withColumn("near", F.least(F.ceil(F.get("p", F.lit(0))["dist"]).cast("int"), last))
    d = d.withColumn("far", F.least(F.col("near") + w, last))
    short = F.col("far") - F.col("near") < w
    a, b = F.get("p", F.when(short, 0).otherwise(F.col("near"))), F.get("p", F.when(short, last).otherwise(F.col("far")))
    d = d.select("path", "side", (a["y"] - b["y"]).alias("vy"), (a["x"] - b["x"]).alias("vx")).withColumn("n", F.hypot("vy", "vx"))
    unit = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(F.lit(0.0))
    return d.select("path", "side", unit("vy").alias("dy"), unit("vx").alias("dx"), F.when(F.col("n") > 0, F.degrees(F.atan(1 / F.col("n")))).otherwise(F.lit(180.0)).alias("err"))


def turn(a: str, b: str) -> Column:
    """Degrees that a line turns from one end into another of a junction; both directions look into it, so 0 goes straight on."""
    dot = F.col(f"{a}.dy") * F.col(f"{b}.dy") + F.col(f"{a}.dx") * F.col(f"{b}.dx")
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -dot))))


def same_thickness(a: str, b: str, sheet_std: float, quantum: float = 1.0) -> Column:
    """Whether two branches may be one line: thicknesses no farther apart than a pixel and both spreads; one that is not measured fits all."""
    t = lambda e: F.nullif(F.col(f"{e}.thickness"), F.lit(float("nan")))
    spread = lambda e: F.greatest(F.col(f"{e}.thickness_std"), F.lit(sheet_std))
    return F.coalesce(F.abs(t(a) - t(b)) <= quantum + F.hypot(spread(a), spread(b)), F.lit(True))


def junction_pairs(ends: DataFrame, sheet_std: float, max_turn: float = 10.0) -> DataFrame:
    """(junc, a, b, score): ends of a junction that continue each other, the straightest first, each once.

    ends: id, junc, branch, dy, dx, err, thickness, thickness_std. The turn may exceed the limit by the error of both directions.
    """
    p, q = ends.alias("p"), ends.alias("q")
    err = F.hypot("p.err", "q.err")
    met = p.join(q, "junc").where((F.col("p.id") < F.col("q.id")) & (F.col("p.branch") != F.col("q.branch")) & (turn("p", "q") <= max_turn + err) & same_thickness("p", "q", sheet_std))
    pairs = met.select(F.col("junc").alias("node"), F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.round(turn("p", "q") + err, 6).alias("score"))
    return graphs.match_greedy(pairs).withColumnRenamed("node", "junc")


def lines_of(branches: DataFrame, pairs: DataFrame) -> DataFrame:
    """branches with line: the smallest branch that pairs (branch numbers a, b) join each with."""
    found = graphs.connected_components(pairs.select("a", "b"))
    return branches.join(found.select(F.col("node").alias("branch"), F.col("component").alias("line")), "branch", "left").withColumn("line", F.coalesce("line", "branch"))


def line_thickness(branches: DataFrame) -> DataFrame:
    """(line, length, thickness): the median thickness of a line's branches weighed by their sections; null if none is measured."""
    measured = branches.where("thickness is not null and not isnan(thickness) and n_sect > 0")
    t = weighted_median(measured, "thickness", "n_sect", ["line"]).withColumnRenamed("median", "thickness")
    return branches.groupBy("line").agg(F.sum("length").alias("length")).join(t, "line", "left")


def junction_lines(ends: DataFrame, pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(junc, line): the thickest line that goes through each junction, else the thickest that ends there; -1 if none is measured. ends: id, junc, line."""
    through = pairs.select("junc", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("through", F.lit(True))
    e = ends.select("id", "junc", "line").join(through, ["junc", "id"], "left").join(lines.select("line", "thickness"), "line", "left")
    rank = F.struct(F.coalesce("through", F.lit(False)), "thickness", -F.col("line"))
    any_through = F.max(F.coalesce("through", F.lit(False))).over(Window.partitionBy("junc"))
    own = e.withColumn("_any", any_through).where("not _any or through")
    best = own.groupBy("junc").agg(F.max_by(F.when(F.col("thickness").isNotNull(), F.col("line")), F.when(F.col("thickness").isNotNull(), rank)).alias("line"))
    return best.select("junc", F.coalesce("line", F.lit(-1)).alias("line"))


def edge_lines(lines: DataFrame, content: DataFrame) -> DataFrame:
    """lines (sheet_id, id, x, y, w, h) with edge: above it or below it, in its columns, there is no content but nearer than its own thickness.

    content: sheet_id, y, x of ink that is no line. A line meets the topmost and lowest content of its columns, not the pixels.
    """
    col = content.groupBy("sheet_id", "x").agg(F.min("y").alias("top"), F.max("y").alias("bottom")).withColumnRenamed("x", "cx")
    under = lines.select("sheet_id", "id", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1)).alias("cx")).join(col, ["sheet_id", "cx"])
    ends = under.groupBy("sheet_id", "id").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    d = lines.join(ends, ["sheet_id", "id"], "left")
    clear = (F.col("top") >= F.col("y") - F.col("h")) | (F.col("bottom") <= F.col("y") + 2 * F.col("h") - 1)
    return d.withColumn("edge", F.coalesce(clear, F.lit(True))).drop("top", "bottom")
