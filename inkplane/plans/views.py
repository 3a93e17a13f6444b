"""Object tables derived from the stored ones, and the same in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sketch(spark, d) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").select(F.concat(F.lit("s"), F.col("label").cast("string")).alias("name"), (F.row_number().over(w) - 1).alias("view_no"), F.col("embedding").alias("vec"))


SKETCH = "sketch as (select 's' || label as name, row_number() over (partition by label order by vec_id) - 1 as view_no, embedding::double[] as vec from embeddings)"


def det(spark, d) -> DataFrame:
    e = table(spark, d, "events").selectExpr("user_id as sheet", "event_id as id", "(event_id * 37) % 600 as x0", "(event_id * 53) % 400 as y0", "60 + event_id % 90 as w", "40 + (event_id * 7) % 70 as h", "value as conf")
    return e.withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + F.col("h"))


DET = """det as (select *, x0 + w as x1, y0 + h as y1 from (select user_id as sheet, event_id as id, (event_id * 37) % 600 as x0,
  (event_id * 53) % 400 as y0, 60 + event_id % 90 as w, 40 + (event_id * 7) % 70 as h, value as conf from events))"""


def px(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sheet_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 255 * F.col("e")))).cast("int")
    return e.select("sheet_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), v.alias("v"))


PX = """px as (select vec_id as sheet_id, (pos - 1) // 8 as y, (pos - 1) % 8 as x, greatest(0, least(255, floor(128 + 255 * e)))::int as v
  from (select vec_id, unnest(embedding::double[]) as e, generate_subscripts(embedding, 1) as pos from embeddings))"""


def profile(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("path"), (F.row_number().over(w) - 1).alias("ord"), F.col("value").alias("t"), F.when(F.col("event_type") == "error", 3).otherwise(2).alias("deg"))


PROFILE = """profile as (select user_id as path, row_number() over (partition by user_id order by ts, event_id) - 1 as ord, value as t,
  case when event_type = 'error' then 3 else 2 end as deg from events)"""


def level(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy((1 + F.col("l_quantity")).alias("lvl")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("w"))


LEVEL = "level as (select 1 + l_quantity as lvl, sum(l_extendedprice::decimal(18,2))::double as w from lineitem group by 1)"


def sheet_size(spark, d) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey as sheet_id", "100 + 13 * p_size as h", "cast(100 + 17 * (p_partkey % 97) as int) as w")


SHEET_SIZE = "sheet_size as (select p_partkey as sheet_id, 100 + 13 * p_size as h, (100 + 17 * (p_partkey % 97))::int as w from part)"


def edge(spark, d) -> DataFrame:
    return table(spark, d, "part").where("p_size <= 6").selectExpr("p_partkey as a", "p_partkey + p_size as b")


EDGE = "edge as (select p_partkey as a, p_partkey + p_size as b from part where p_size <= 6)"


def ends(spark, d) -> DataFrame:
    """Ends of paths at nodes: a node of ten neighbouring parts, a direction by the part's key, a circle by its size."""
    return table(spark, d, "part").selectExpr(
        "p_partkey as id", "p_partkey div 10 as node", "round(cos(radians((p_partkey * 47) % 360)), 9) as dx", "round(sin(radians((p_partkey * 47) % 360)), 9) as dy",
        "cast(p_partkey % 7 as double) as cx", "cast(p_partkey % 5 as double) as cy", "cast(p_size as double) as r", "p_size % 3 = 0 as thick", "p_retailprice as level", "p_size as len",
    )


ENDS = """ends as (select p_partkey as id, p_partkey // 10 as node, round(cos(radians((p_partkey * 47) % 360)), 9) as dx, round(sin(radians((p_partkey * 47) % 360)), 9) as dy,
  (p_partkey % 7)::double as cx, (p_partkey % 5)::double as cy, p_size::double as r, p_size % 3 = 0 as thick, p_retailprice as level, p_size as len from part)"""


def segment(spark, d) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "p_partkey % 20 as sheet_id", "p_partkey as seg_id", "p_size % 3 as holes", "p_size % 2 as free", "p_size % 5 as bends", "p_size < 10 as small", "p_partkey % 11 = 0 as circle",
        "p_partkey % 4 as n_thin", "p_partkey % 3 = 0 as inside", "(p_partkey * 37) % 3000 as x0", "(p_partkey * 53) % 2000 as y0", "(p_partkey * 37) % 3000 + 20 + p_size as x1", "(p_partkey * 53) % 2000 + 20 + p_size as y1",
    )


SEGMENT = """segment as (select p_partkey % 20 as sheet_id, p_partkey as seg_id, p_size % 3 as holes, p_size % 2 as free, p_size % 5 as bends, p_size < 10 as small, p_partkey % 11 = 0 as circle,
  p_partkey % 4 as n_thin, p_partkey % 3 = 0 as inside, (p_partkey * 37) % 3000 as x0, (p_partkey * 53) % 2000 as y0, (p_partkey * 37) % 3000 + 20 + p_size as x1, (p_partkey * 53) % 2000 + 20 + p_size as y1 from part)"""


def tri(spark, d) -> DataFrame:
    """A triangle a part, in pixels of a 640 x 640 picture."""
    x = lambda k, m: f"cast((p_partkey * {k} + p_size * {m}) % 640 as double)"
    poly = ", ".join(f"named_struct('x', {x(a, b)}, 'y', {x(c, e)})" for a, b, c, e in ((3, 5, 7, 2), (11, 3, 5, 13), (2, 17, 19, 7)))
    return table(spark, d, "part").selectExpr("p_partkey as obj_id", "p_size % 4 as cls", f"array({poly}) as poly")


_X = "((p_partkey * {} + p_size * {}) % 640)::double"
TRI = "tri as (select p_partkey as obj_id, p_size % 4 as cls, " + ", ".join(f"{_X.format(a, b)} as x{i}, {_X.format(c, e)} as y{i}" for i, (a, b, c, e) in enumerate(((3, 5, 7, 2), (11, 3, 5, 13), (2, 17, 19, 7)))) + " from part)"
