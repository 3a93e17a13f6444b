"""Queries on sheets, tiles, views and their scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tiles
from . import views
from .registry import query

_AXIS = "list_transform(range(0, (case when {s} <= 640 then 1 else 1 + ceil(({s} - 640) / 512.0) end)::bigint), lambda i: least(i * 512, greatest(0, {s} - 640))::int)"
_GRID = f"""{views.SHEET_SIZE}, big as (select sheet_id, h * 2 as h, w * 2 as w from sheet_size), g as (select sheet_id, h, w, {_AXIS.format(s="h")} as ys, {_AXIS.format(s="w")} as xs from big),
gy as (select *, unnest(ys) as y0, generate_subscripts(ys, 1) - 1 as r from g), gx as (select *, unnest(xs) as x0, generate_subscripts(xs, 1) - 1 as c from gy),
tile as (select sheet_id, h, w, (r * len(xs) + c)::int as tile_id, x0, y0, least(x0 + 640, w)::int as x1, least(y0 + 640, h)::int as y1 from gx)"""


def _big(spark, d):
    return views.sheet_size(spark, d).withColumn("h", F.col("h") * 2).withColumn("w", F.col("w") * 2)


@query(f"with {_GRID} select sheet_id, tile_id, x0, y0, x1, y1 from tile")
def tile_grid(spark, d):
    return tiles.grid(_big(spark, d))


_CUT = "select distinct sheet_id, {0}0, {0}1, {1} as size from tile"
_ZONES = f"""{_GRID}, sx as ({_CUT.format("x", "w")}), sy as ({_CUT.format("y", "h")}),
zx as (select sheet_id, x0, coalesce((lag(x1) over k + x0) / 2.0, 0.0)::double as zx0, coalesce((x1 + lead(x0) over k) / 2.0, size)::double as zx1 from sx window k as (partition by sheet_id order by x0)),
zy as (select sheet_id, y0, coalesce((lag(y1) over k + y0) / 2.0, 0.0)::double as zy0, coalesce((y1 + lead(y0) over k) / 2.0, size)::double as zy1 from sy window k as (partition by sheet_id order by y0))"""


@query(f"with {_ZONES} select t.sheet_id, t.tile_id, zx0, zy0, zx1, zy1 from tile t join zx using (sheet_id, x0) join zy using (sheet_id, y0)")
def tile_zones(spark, d):
    return tiles.zones(tiles.grid(_big(spark, d)), _big(spark, d)).select("sheet_id", "tile_id", "zx0", "zy0", "zx1", "zy1")


@query(f"with {_ZONES} select sheet_id, sum((zx1 - zx0) * (zy1 - zy0))::double as zone_area, max(h * w)::double as area from tile t join zx using (sheet_id, x0) join zy using (sheet_id, y0) group by sheet_id")
def zone_partition_check(spark, d):
    big = _big(spark, d)
    z = tiles.zones(tiles.grid(big), big).join(big.hint("merge"), "sheet_id")
    return z.groupBy("sheet_id").agg(F.sum((F.col("zx1") - F.col("zx0")) * (F.col("zy1") - F.col("zy0"))).alias("zone_area"), F.max(F.col("h") * F.col("w")).cast("double").alias("area"))


@query("select p_partkey as sheet_id, round(case when abs(least(9.0 / (p_size / 4.0), 2.0) - 1) <= 0.15 then 1.0 else least(9.0 / (p_size / 4.0), 2.0) end, 9) as scale from part")
def scale_decision(spark, d):
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("sheet_id"), F.round(tiles.scale_of(F.col("p_size") / 4.0, 9.0, 0.15, 2.0), 9).alias("scale"))


@query(f"""with {views.PX}, t as (select sheet_id, 5 + sheet_id % 7 as th, 5 + sheet_id % 11 as tw from (select distinct sheet_id from px)),
g as (select sheet_id, th, tw, ty, unnest(range(0, tw)) as tx from (select *, unnest(range(0, th)) as ty from t))
select g.sheet_id, ty::int as ty, tx::int as tx, v from g join px on px.sheet_id = g.sheet_id and px.y = least(floor(ty * 8 / th), 7) and px.x = least(floor(tx * 8 / tw), 7)""")
def scale_lookup(spark, d):
    p = views.px(spark, d)
    t = p.select("sheet_id").distinct().selectExpr("sheet_id", "8 as h", "8 as w", "cast(5 + sheet_id % 7 as int) as th", "cast(5 + sheet_id % 11 as int) as tw")
    return tiles.scale_lookup(p, t)


@query(f"""with {views.PX}, k as (select *, unnest([0, 1, 2, 3]) as k from px)
select sheet_id, k, (case k when 0 then y when 1 then 7 - x when 2 then 7 - y else x end)::int as ry, (case k when 0 then x when 1 then y when 2 then 7 - x else 7 - y end)::int as rx, v from k""")
def px_rot90(spark, d):
    return tiles.quarter_turns(views.px(spark, d), 8)


@query(f"with {views.SEGMENT} select sheet_id, seg_id, (row_number() over (partition by sheet_id order by (x1 - x0) * (y1 - y0) desc, y0, x0) - 1)::int as k from segment")
def view_order(spark, d):
    return tiles.order_views(views.segment(spark, d)).select("sheet_id", "seg_id", F.col("k").cast("int"))


@query(f"""with {views.SEGMENT}, f as (select *, 224.0 / max(greatest(x1 - x0, y1 - y0)) over (partition by sheet_id) as f from segment),
c as (select sheet_id, seg_id, greatest(1, round_even((x1 - x0) * f, 0))::int as cw, greatest(1, round_even((y1 - y0) * f, 0))::int as ch from f)
select *, trunc((224 - cw) / 2.0)::int as ox, trunc((224 - ch) / 2.0)::int as oy from c""")
def crop_geometry(spark, d):
    return tiles.crop_geometry(views.segment(spark, d), 224).select("sheet_id", "seg_id", "cw", "ch", "ox", "oy")
