"""Label polygons and data sets: parsing, clipping to tiles, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def parse(lines: DataFrame, n_classes: int) -> DataFrame:
    """lines (name, line) of a class and normalised x y pairs, as cls, poly and error: a line that breaks a rule has no polygon but says which."""
    t = F.split(F.trim("line"), r"\s+")
    numbers = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda s: s.try_cast("double"))
    d = lines.withColumn("_n", F.size(t) - 1).withColumn("cls", t[0].try_cast("int")).withColumn("_v", numbers)
    bad = lambda v: v.isNull() | F.isnan(v) | (v < -1e-6) | (v > 1 + 1e-6)
    error = (
        F.when(F.col("cls").isNull(), "class is not a number").when((F.col("cls") < 0) | (F.col("cls") >= n_classes), "class out of range")
        .when(F.col("_n") < 6, "less than three points").when(F.col("_n") % 2 == 1, "odd number of coordinates").when(F.exists("_v", bad), "coordinate out of range")
    )
    poly = F.transform(F.sequence(F.lit(0), F.greatest((F.col("_n") / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get("_v", 2 * i).alias("x"), F.get("_v", 2 * i + 1).alias("y")))
    return d.withColumn("error", error).withColumn("poly", F.when(error.isNull(), poly)).drop("_n", "_v")


def clip_to_tiles(polygons: DataFrame, tiles: DataFrame, min_area: float = 0.5) -> DataFrame:
    """Polygons cut to the tiles they meet: share of their area inside and whether that is enough to keep them there.

    polygons: sheet_id, obj_id, cls, poly; tiles: sheet_id, tile_id, x0, y0, x1, y1. Pairs whose boxes miss each other are left before clipping.
    """
    xs, ys = F.transform("poly", lambda p: p["x"]), F.transform("poly", lambda p: p["y"])
    d = polygons.select("*", F.array_min(xs).alias("px0"), F.array_max(xs).alias("px1"), F.array_min(ys).alias("py0"), F.array_max(ys).alias("py1"))
    met = d.join(tiles, "sheet_id").where("px0 < x1 and px1 > x0 and py0 < y1 and py1 > y0")
    # exploded, so that no later filter or column clips again
    cut = F.array(G.clip(F.col("poly"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    met = met.withColumn("cut", F.explode(F.filter(cut, lambda c: c.isNotNull())))
    share = G.polygon_area(F.col("cut")) / G.polygon_area(F.col("poly"))
    return met.select("sheet_id", "tile_id", "obj_id", "cls", "cut", share.alias("share")).withColumn("kept", F.col("share") >= min_area)


def classify_tiles(tiles: DataFrame, clipped: DataFrame) -> DataFrame:
    """tiles with kind: positive with a kept object, ambiguous with cut ones only, else background."""
    k = clipped.groupBy("sheet_id", "tile_id").agg(F.bool_or("kept").alias("kept"))
    kind = F.when(F.col("kept").isNull(), "background").when(F.col("kept"), "positive").otherwise("ambiguous")
    return tiles.join(k, ["sheet_id", "tile_id"], "left").withColumn("kind", kind).drop("kept")


def sample_background(tiles: DataFrame, ratio: float = 0.25, seed: int = 0) -> DataFrame:
    """As many background tiles as the ratio allows to each positive one, in an order of hashes."""
    n = int(round(ratio * tiles.where("kind = 'positive'").count()))
    return tiles.where("kind = 'background'").orderBy(F.xxhash64(F.lit(seed), "sheet_id", "tile_id"), "sheet_id", "tile_id").limit(n)


#: Sheets up to which every split is tried, and splits drawn beyond.
MOST_SHEETS, TRIALS = 12, 5000


def choose_validation(counts: DataFrame, share: float = 0.2, seed: int = 0) -> DataFrame:
    """(names, n): the proper subset of sheets whose objects come nearest to a share, and how many they are.

    Up to MOST_SHEETS sheets every subset is tried, of equals the one of least bits in order of name. Beyond, TRIALS subsets are drawn: a
    trial takes each sheet with a chance of its own, by hashes of the seed, so reruns agree.
    """
    spark = counts.sparkSession
    some = counts.orderBy("name").limit(MOST_SHEETS + 1).collect()
    if len(some) < 2:
        raise ValueError("two sheets at least can be split")
    total = F.broadcast(counts.agg(F.sum("n").alias("total"), F.count("*").alias("sheets")))
    if len(some) <= MOST_SHEETS:
        listed = spark.createDataFrame([(i, r["name"], r["n"]) for i, r in enumerate(some)], "bit int, name string, n long")
        trial = spark.range(1, (1 << len(some)) - 1).crossJoin(F.broadcast(listed)).where(F.expr("shiftright(id, bit) & 1 = 1"))
    else:
        chance = lambda *of: (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 20)) + 0.5) / (1 << 20)
        trial = counts.select("name", "n").crossJoin(F.broadcast(spark.range(TRIALS))).where(chance("id", "name") < chance("id"))
    sums = trial.groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("taken"), F.array_sort(F.collect_list("name")).alias("names")).crossJoin(total).where("taken < sheets")
    off = F.abs(F.col("n") - F.lit(share) * F.col("total"))
    best = sums.agg(F.min_by(F.struct("names", "n"), F.struct(off, "id")).alias("b"))
    return best.where("b is not null").select("b.names", F.col("b.n").alias("n"))


def class_coverage(objects: DataFrame, n_classes: int) -> DataFrame:
    """For each part the classes it lacks."""
    seen = objects.groupBy("part").agg(F.collect_set("cls").alias("seen"))
    return seen.select("part", F.array_sort(F.array_except(F.array(*[F.lit(c) for c in range(n_classes)]), "seen")).alias("missing"))


def resolve_stems(tokens: DataFrame, stems: DataFrame) -> DataFrame:
    """tokens with the one stem each names, in full or by what follows its last dash; stem is null and matches tells how many otherwise."""
    names = stems.select("stem", F.col("stem").alias("name")).unionByName(stems.select("stem", F.substring_index("stem", "-", -1).alias("name"))).distinct()
    met = tokens.join(names, tokens["token"] == names["name"], "left")
    g = met.groupBy("token").agg(F.count_distinct("stem").alias("matches"), F.min("stem").alias("stem"))
    return g.select("token", "matches", F.when(F.col("matches") == 1, F.col("stem")).alias("stem"))


def object_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("name").agg(F.count("*").alias("n"))


def as_line(cls: Column, poly: Column) -> Column:
    """A label line: the class and the points with six digits."""
    return F.concat_ws(" ", cls.cast("string"), F.array_join(F.transform(poly, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), " "))
