"""Queries on polygons, labels and data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import labels
from . import views
from .registry import query

_AREA = "(abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y0 - x0 * y2) / 2)"


@query(f"with {views.TRI} select obj_id, {_AREA} as area from tri")
def poly_area(spark, d):
    return views.tri(spark, d).select("obj_id", G.polygon_area(F.col("poly")).alias("area"))


def _side(n: int, axis: str, bound: str, above: bool) -> str:
    """A side of the clip in SQL: table p{n} of ordered points to p{n + 1}."""
    o = "y" if axis == "x" else "x"
    inside = (lambda p: f"{p}.{axis} >= {bound}") if above else (lambda p: f"{p}.{axis} <= {bound}")
    cross = {axis: f"{bound}::double", o: f"p.{o} + ({bound} - p.{axis}) / (q.{axis} - p.{axis}) * (q.{o} - p.{o})"}
    point = f"{{'x': {cross['x']}, 'y': {cross['y']}}}"
    q = "{'x': q.x, 'y': q.y}"
    return f"""n{n} as (select *, coalesce(lead(k) over (partition by obj_id, tile_id order by k), min(k) over (partition by obj_id, tile_id)) as nk from p{n}),
e{n} as (select p.*, case when {inside('p')} and {inside('q')} then [{q}] when {inside('p')} then [{point}] when {inside('q')} then [{point}, {q}] else [] end as pts
  from n{n} p join p{n} q on q.obj_id = p.obj_id and q.tile_id = p.tile_id and q.k = p.nk),
p{n + 1} as (select obj_id, tile_id, tx0, ty0, tx1, ty1, k * 2 + i as k, pt.x as x, pt.y as y from (select obj_id, tile_id, tx0, ty0, tx1, ty1, k, unnest(pts) as pt, generate_subscripts(pts, 1) - 1 as i from e{n}))"""


_CLIP = f"""{views.TRI}, tile(tile_id, tx0, ty0, tx1, ty1) as (values (0, 0, 0, 320, 320), (1, 256, 0, 640, 320), (2, 0, 256, 320, 640), (3, 256, 256, 640, 640)),
p0 as (select obj_id, tile_id, tx0, ty0, tx1, ty1, k, case k when 0 then x0 when 1 then x1 else x2 end as x, case k when 0 then y0 when 1 then y1 else y2 end as y from tri, tile, (values (0), (1), (2)) v(k)
  where least(x0, x1, x2) < tx1 and greatest(x0, x1, x2) > tx0 and least(y0, y1, y2) < ty1 and greatest(y0, y1, y2) > ty0),
{_side(0, "x", "p.tx0", True)}, {_side(1, "x", "p.tx1", False)}, {_side(2, "y", "p.ty0", True)}, {_side(3, "y", "p.ty1", False)},
s as (select *, coalesce(lead(k) over k, min(k) over (partition by obj_id, tile_id)) as nk from p4 window k as (partition by obj_id, tile_id order by k)),
a as (select s.obj_id, s.tile_id, abs(sum(s.x * q.y - q.x * s.y)) / 2 as area from s join p4 q on q.obj_id = s.obj_id and q.tile_id = s.tile_id and q.k = s.nk group by 1, 2),
c as (select a.obj_id, a.tile_id, a.area / {_AREA} as share from a join tri using (obj_id) where a.area > 1e-9 and {_AREA} > 0)"""


def _clipped(spark, d):
    tri = views.tri(spark, d).withColumn("sheet_id", F.lit(0))
    tiles = spark.createDataFrame([(0, 0, 0, 0, 320, 320), (0, 1, 256, 0, 640, 320), (0, 2, 0, 256, 320, 640), (0, 3, 256, 256, 640, 640)], "sheet_id int, tile_id int, x0 int, y0 int, x1 int, y1 int")
    return tiles, labels.clip_to_tiles(tri, F.broadcast(tiles)).where(G.polygon_area(F.col("cut")) > 1e-9)


@query(f"with {_CLIP} select obj_id, tile_id, round(share, 6) as share, round(share, 9) >= 0.5 as kept from c")
def tile_labels(spark, d):
    return _clipped(spark, d)[1].select("obj_id", "tile_id", F.round("share", 6).alias("share"), (F.round("share", 9) >= 0.5).alias("kept"))


@query(f"with {_CLIP} select tile_id, count(*)::bigint as objects, count(*) filter (where round(share, 9) >= 0.5)::bigint as kept from c group by tile_id")
def tile_object_counts(spark, d):
    return _clipped(spark, d)[1].groupBy("tile_id").agg(F.count("*").alias("objects"), F.count(F.when(F.round("share", 9) >= 0.5, 1)).alias("kept"))


_LINES = """lines as (select p_partkey as name, case p_size % 10 when 0 then 'x 0.1 0.2' when 1 then '1 0.1 0.2 0.3 0.4' when 2 then '9 0 0 1 0 1 1' when 3 then '1 0 0 1 0 1 1 0.5' when 4 then '2 0 0 1.5 0 1 1'
  else '  ' || p_size % 4 || ' 0.25 0.5  0.75 0.5 ' || p_size / 100.0 || ' 1 ' end as line from part)"""
_TOKENS = "t as (select name, regexp_split_to_array(trim(line), '\\s+') as t from lines), n as (select name, try_cast(t[1] as int) as cls, t, len(t) - 1 as n, list_transform(t[2:], lambda s: try_cast(s as double)) as v from t)"


def _lines(spark, d):
    return views.table(spark, d, "part").selectExpr("p_partkey as name", """case p_size % 10 when 0 then 'x 0.1 0.2' when 1 then '1 0.1 0.2 0.3 0.4' when 2 then '9 0 0 1 0 1 1' when 3 then '1 0 0 1 0 1 1 0.5' when 4 then '2 0 0 1.5 0 1 1'
      else concat('  ', p_size % 4, ' 0.25 0.5  0.75 0.5 ', p_size / 100, ' 1 ') end as line""")


@query(f"""with {_LINES}, {_TOKENS}, e as (select name, cls, v, case when cls is null then 'class is not a number' when cls < 0 or cls >= 4 then 'class out of range' when n < 6 then 'less than three points'
when n % 2 = 1 then 'odd number of coordinates' when len(list_filter(v, lambda c: c is null or c < -1e-6 or c > 1 + 1e-6)) > 0 then 'coordinate out of range' end as error from n)
select name, coalesce(cls, -1) as cls, error, case when error is null then len(v) // 2 else 0 end::int as points, case when error is null then round(list_sum(v), 6) else 0 end::double as total from e""")
def label_parse(spark, d):
    p = labels.parse(_lines(spark, d), 4)
    total = F.aggregate("poly", F.lit(0.0), lambda s, q: s + q["x"] + q["y"])
    return p.select("name", F.coalesce("cls", F.lit(-1)).alias("cls"), "error", F.when(F.col("error").isNull(), F.size("poly")).otherwise(0).alias("points"), F.coalesce(F.round(total, 6), F.lit(0.0)).alias("total"))


@query("""with c as (select 's' || label as name, row_number() over (order by 's' || label) - 1 as i, count(*) as n from embeddings group by label),
s as (select m, sum(n)::bigint as n, string_agg(name, ',' order by name) as names from range(1, 1023) r(m), c where (m >> i) & 1 = 1 group by m)
select names, n from s order by abs(n - 0.2 * (select sum(n) from c)), m limit 1""")
def val_split(spark, d):
    return labels.choose_validation(labels.object_counts(views.sketch(spark, d))).select(F.array_join("names", ",").alias("names"), "n")


@query("select case when p_partkey % 5 = 0 then 'val' else 'train' end as part, array_to_string(list_filter([0, 1, 2, 3, 4, 5, 6, 7, 8, 9], lambda c: not list_contains(list(p_size % 7), c)), ',') as missing from part group by 1")
def class_coverage(spark, d):
    o = views.table(spark, d, "part").select(F.when(F.col("p_partkey") % 5 == 0, "val").otherwise("train").alias("part"), (F.col("p_size") % 7).alias("cls"))
    return labels.class_coverage(o, 10).select("part", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


@query("""with s as (select distinct p_brand || '-' || p_size as stem from part), n as (select stem, stem as name from s union select stem, split_part(stem, '-', -1) from s),
t as (select distinct p_size::varchar as token from part union select distinct p_brand || '-' || p_size from part union select 'none')
select token, count(distinct stem)::bigint as matches, case when count(distinct stem) = 1 then min(stem) end as stem from t left join n on token = name group by token""")
def stem_resolve(spark, d):
    p = views.table(spark, d, "part")
    stems = p.select(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("stem")).distinct()
    tokens = p.select(F.col("p_size").cast("string").alias("token")).union(stems).union(spark.sql("select 'none'")).distinct()
    return labels.resolve_stems(tokens, stems)


@query(f"""with {_CLIP}, k as (select obj_id % 50 as sheet_id, tile_id, bool_or(round(share, 9) >= 0.5) as kept from c group by 1, 2), sh as (select distinct obj_id % 50 as sheet_id from tri)
select sh.sheet_id, t.tile_id, case when kept is null then 'background' when kept then 'positive' else 'ambiguous' end as kind from sh cross join tile t left join k using (sheet_id, tile_id)""")
def tile_kinds(spark, d):
    tiles, c = _clipped(spark, d)
    c = c.select((F.col("obj_id") % 50).alias("sheet_id"), "tile_id", (F.round("share", 9) >= 0.5).alias("kept"))
    sheets = views.tri(spark, d).select((F.col("obj_id") % 50).alias("sheet_id")).distinct()
    return labels.classify_tiles(sheets.crossJoin(F.broadcast(tiles.drop("sheet_id"))), c).select("sheet_id", "tile_id", "kind")


@query("select round_even(0.25 * count(*) filter (where p_size % 3 = 0), 0)::bigint as n from part where (select count(*) from part where p_size % 3 = 1) >= 0.25 * (select count(*) from part where p_size % 3 = 0)")
def bg_sample_size(spark, d):
    kind = F.element_at(F.array(F.lit("positive"), F.lit("background"), F.lit("ambiguous")), F.col("p_size") % 3 + 1)
    t = views.table(spark, d, "part").select(F.col("p_partkey").alias("sheet_id"), F.lit(0).alias("tile_id"), kind.alias("kind"))
    return labels.sample_background(t).agg(F.count("*").alias("n"))


@query("select p_partkey as id, p_size % 4 || ' ' || printf('%.6f %.6f', p_size / 50.0, p_partkey % 30 / 30.0) || ' ' || printf('%.6f %.6f', p_size / 60.0, 0.5) as line from part")
def label_lines(spark, d):
    poly = F.array(F.struct((F.col("p_size") / 50).alias("x"), (F.col("p_partkey") % 30 / 30).alias("y")), F.struct((F.col("p_size") / 60).alias("x"), F.lit(0.5).alias("y")))
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), labels.as_line(F.col("p_size") % 4, poly).alias("line"))
