"""Queries on cleaning rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rasters, rules
from . import views
from .registry import query


def _ink(spark, d):
    return views.px(spark, d).where("v <= 128").select("sheet_id", "y", "x")


_PARTS = f"""{views.PX}, ink as (select sheet_id, y, x from px where v <= 128), reach(sheet_id, p, r) as (select sheet_id, y * 8 + x, y * 8 + x from ink union
select r.sheet_id, i.y * 8 + i.x, r.r from reach r join ink i on i.sheet_id = r.sheet_id and abs(i.y - r.p // 8) <= 1 and abs(i.x - r.p % 8) <= 1),
part8 as (select sheet_id, p // 8 as y, p % 8 as x, min(r) as component from reach group by sheet_id, p)"""
_BOX = "bx as (select distinct sheet_id, k as id, (sheet_id + k) % 5 as x0, (sheet_id + 2 * k) % 4 as y0, (sheet_id + k) % 5 + 2 + k as x1, (sheet_id + 2 * k) % 4 + 3 + k as y1 from px, (values (0), (1)) v(k))"


def _boxes(spark, d):
    b = views.px(spark, d).select("sheet_id").distinct().selectExpr("sheet_id", "explode(array(0, 1)) as id")
    return b.selectExpr("sheet_id", "id", "(sheet_id + id) % 5 as x0", "(sheet_id + 2 * id) % 4 as y0", "(sheet_id + id) % 5 + 2 + id as x1", "(sheet_id + 2 * id) % 4 + 3 + id as y1")


@query(f"""with recursive {_PARTS}, {_BOX}, area as (select sheet_id, component, count(*) as area from part8 group by all),
half as (select sheet_id, component, count(*) as n from (select distinct p.* from part8 p join bx b on b.sheet_id = p.sheet_id and x >= x0 and x < x1 and y >= y0 and y < y1) group by all),
whole as (select p.sheet_id, component, id, count(*) as n from part8 p join bx b on b.sheet_id = p.sheet_id and x >= x0 - 1 and x < x1 + 1 and y >= y0 - 1 and y < y1 + 1 group by all)
select sheet_id, component::bigint as component from half join area using (sheet_id, component) where 2 * n > area union select sheet_id, component from whole join area using (sheet_id, component) where n = area""")
def text_components(spark, d):
    b = _boxes(spark, d)
    wide = b.selectExpr("sheet_id", "id", "x0 - 1 as x0", "y0 - 1 as y0", "x1 + 1 as x1", "y1 + 1 as y1")
    return rules.text_components(rasters.components(_ink(spark, d), 8), b, wide).select("sheet_id", F.col("component").cast("long").alias("component"))


_LABELS = f"{views.PX}, lab as (select sheet_id, y, x, case when v <= 128 then 1 + (x // 3 + y // 3) % 4 else 0 end as seg_id from px), path as (select sheet_id, x % 3 as path_id, y, x from px)"


def _labels(spark, d):
    p = views.px(spark, d)
    lab = p.select("sheet_id", "y", "x", F.when(F.col("v") <= 128, 1 + (F.floor(F.col("x") / 3) + F.floor(F.col("y") / 3)) % 4).otherwise(0).alias("seg_id"))
    return lab, p.select("sheet_id", (F.col("x") % 3).alias("path_id"), "y", "x")


@query(f"""with {_LABELS}, n as (select p.sheet_id, path_id, seg_id, count(*) as n from path p join lab using (sheet_id, y, x) where seg_id > 0 group by all),
b as (select * from n qualify row_number() over (partition by sheet_id, path_id order by n desc, seg_id) = 1)
select p.sheet_id, p.path_id::bigint as path_id, coalesce(seg_id, 0)::bigint as seg_id from (select distinct sheet_id, path_id from path) p left join b using (sheet_id, path_id)""")
def path_majority_segment(spark, d):
    lab, path = _labels(spark, d)
    return rules.majority_segment(path, lab).select("sheet_id", F.col("path_id").cast("long").alias("path_id"), F.col("seg_id").cast("long").alias("seg_id"))


@query(f"with {_LABELS} select p.sheet_id, seg_id::bigint as seg_id, count(distinct path_id)::bigint as n_thin from path p join lab using (sheet_id, y, x) where seg_id > 0 group by all")
def thin_touch_count(spark, d):
    lab, path = _labels(spark, d)
    return rules.thin_touches(path, lab).withColumn("seg_id", F.col("seg_id").cast("long"))


@query(f"""with {_LABELS}, seg as (select * from lab where seg_id > 0), hull as (select sheet_id, y, x, 1 + x // 4 as hull from px where v <= 200), a as (select sheet_id, seg_id, count(*) as area from seg group by all),
n as (select s.sheet_id, seg_id, hull, count(*) as n from seg s join hull using (sheet_id, y, x) group by all), b as (select * from n qualify row_number() over (partition by sheet_id, seg_id order by n desc, hull) = 1)
select sheet_id, seg_id::bigint as seg_id, (case when 2 * n > area then hull else 0 end)::bigint as owner from a left join b using (sheet_id, seg_id)""")
def owner_argmax(spark, d):
    lab, _ = _labels(spark, d)
    hull = views.px(spark, d).where("v <= 200").select("sheet_id", "y", "x", (1 + F.floor(F.col("x") / 4)).alias("hull"))
    return rules.owners(lab.where("seg_id > 0"), hull).select("sheet_id", F.col("seg_id").cast("long").alias("seg_id"), F.col("owner").cast("long").alias("owner"))


_HULLS = "hulls as (select sheet_id, y, x, 1 + k as hull, 10 + (sheet_id + k * k) % 3 as area from px, (values (0), (1), (2)) v(k) where x >= k and x < k + 5 and y >= (sheet_id + k) % 3 and y < 5 + k)"


def _hulls(spark, d):
    h = views.px(spark, d).select("sheet_id", "y", "x", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    h = h.where("x >= k and x < k + 5 and y >= (sheet_id + k) % 3 and y < 5 + k")
    return h.selectExpr("sheet_id", "y", "x", "1 + k as hull", "10 + (sheet_id + k * k) % 3 as area")


@query(f"with {views.PX}, {_HULLS} select sheet_id, y::int as y, x::int as x, hull::bigint as hull from hulls qualify row_number() over (partition by sheet_id, y, x order by area desc, hull desc) = 1")
def hull_paint(spark, d):
    return rules.paint_order(_hulls(spark, d)).select("sheet_id", "y", "x", F.col("hull").cast("long").alias("hull"))


@query(f"""with {_LABELS}, {_HULLS}, top as (select * from hulls qualify row_number() over (partition by sheet_id, y, x order by area desc, hull desc) = 1), seg as (select * from lab where seg_id > 0),
a as (select sheet_id, seg_id, count(*) as area from seg group by all), n as (select s.sheet_id, seg_id, hull, count(*) as n from seg s join top using (sheet_id, y, x) group by all),
b as (select * from n qualify row_number() over (partition by sheet_id, seg_id order by n desc, hull) = 1)
select sheet_id, seg_id::bigint as seg_id, (case when 2 * n > area then hull else 0 end)::bigint as owner from a left join b using (sheet_id, seg_id)""")
def painted_owners(spark, d):
    lab, _ = _labels(spark, d)
    shown = rules.paint_order(_hulls(spark, d))
    return rules.owners(lab.where("seg_id > 0"), shown).select("sheet_id", F.col("seg_id").cast("long").alias("seg_id"), F.col("owner").cast("long").alias("owner"))


_HOLES = "hole as (select sheet_id, 1 + (x // 3 + 2 * (y // 3)) % 5 as hole, y, x from px where v > 150), centre as (select sheet_id, 1.5 + (sheet_id + k) % 6 as cy, 0.25 + (2 * sheet_id + 3 * k) % 8 as cx from (select distinct sheet_id from px), (values (0), (1)) v(k))"


@query(f"with {views.PX}, {_HOLES}, t as (select h.sheet_id, hole, bool_or(cy is not null) as text from hole h left join centre c on c.sheet_id = h.sheet_id and floor(cy) = y and floor(cx) = x group by all) select sheet_id, count(*)::bigint as holes, count(*) filter (where not text)::bigint as free from t group by sheet_id")
def free_holes(spark, d):
    p = views.px(spark, d)
    holes = p.where("v > 150").selectExpr("sheet_id", "1 + (x div 3 + 2 * (y div 3)) % 5 as hole", "y", "x")
    centres = p.select("sheet_id").distinct().selectExpr("sheet_id", "explode(array(0, 1)) as k").selectExpr("sheet_id", "1.5 + (sheet_id + k) % 6 as y", "0.25 + (2 * sheet_id + 3 * k) % 8 as x")
    t = rules.with_text(holes, centres)
    return t.groupBy("sheet_id").agg(F.count("*").alias("holes"), F.count_if(~F.col("text")).alias("free"))


@query(f"with {views.SEGMENT} select sheet_id, n_thin as component, count(*)::bigint as cells, count(*) filter (where small or free = 1)::bigint as good from segment group by all having count(*) >= 2 and 2 * count(*) filter (where small or free = 1) > count(*)")
def table_rule(spark, d):
    c = views.segment(spark, d).select("sheet_id", F.col("n_thin").alias("component"), (F.col("small") | (F.col("free") == 1)).alias("good"))
    return rules.tables(c)


_VIEW = "(free > 0 and not small and not circle and n_thin > 0)"


@query(f"with {views.SEGMENT} select seg_id, {_VIEW} as view from segment")
def view_rule(spark, d):
    return views.segment(spark, d).select("seg_id", rules.is_view().alias("view"))


@query(f"with {views.SEGMENT} select seg_id, case when inside then small and holes = 0 else small or not ({_VIEW} or (holes = 0 and bends > 2 and n_thin > 0)) end as mark from segment")
def mark_rule(spark, d):
    return views.segment(spark, d).select("seg_id", rules.is_mark().alias("mark"))


@query(f"""with {views.DET}, t as (select sheet, median(least(w, h)) as text_h from det group by sheet) select id, greatest(w, h) < text_h * 1.2 as small from det join t using (sheet)""")
def small_rule(spark, d):
    det = views.det(spark, d)
    th = rules.text_height(det.withColumnRenamed("sheet", "sheet_id")).withColumnRenamed("sheet_id", "sheet")
    return det.join(th, "sheet").select("id", rules.is_small(F.col("w"), F.col("h"), F.col("text_h"), 1.2).alias("small"))


@query(f"""with {views.PX}, p as (select sheet_id, y // 4 as seg_id, y, x from px where v <= 110), c as (select *, avg(y) over k as my, avg(x) over k as mx from p window k as (partition by sheet_id, seg_id)),
r as (select sheet_id, seg_id, sqrt(pow(y - my, 2) + pow(x - mx, 2)) as r from c), m as (select *, avg(r) over (partition by sheet_id, seg_id) as mr from r)
select sheet_id, seg_id::bigint as seg_id, round(max(abs(r - mr)), 9) <= 1.0 as circle from m group by all""")
def circle_rule(spark, d):
    p = views.px(spark, d).where("v <= 110").select("sheet_id", F.floor(F.col("y") / 4).alias("seg_id"), "y", "x")
    return rules.circles(p)


@query(f"with {views.SEGMENT} select sheet_id, n_thin as view, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, (max(x1) - min(x0)) * (max(y1) - min(y0)) as area from segment group by all")
def view_boxes(spark, d):
    return rules.view_boxes(views.segment(spark, d).withColumn("view", F.col("n_thin")))


@query(f"with {views.PX}, m as (select distinct sheet_id, y, x from px where v <= 60) select p.sheet_id, p.y::int as y, p.x::int as x, m.y is not null as \"on\" from px p left join m on m.sheet_id = p.sheet_id and m.y = floor(p.y * 0.5) and m.x = floor(p.x * 0.75)")
def arrow_cover(spark, d):
    p = views.px(spark, d)
    return rules.arrow_cover(p.select("sheet_id", "y", "x"), p.where("v <= 60"), 0.5, 0.75).select("sheet_id", "y", "x", "on")


@query(f"with {_LABELS} select sheet_id, path_id::bigint as path_id, count(*)::bigint as n from path where not exists (select 1 from px where px.sheet_id = path.sheet_id and v <= 70 and px.x % 3 = path.path_id) group by all")
def remove_paths(spark, d):
    _, path = _labels(spark, d)
    gone = views.px(spark, d).where("v <= 70").select("sheet_id", (F.col("x") % 3).alias("path_id"))
    return rules.remove(path, gone).groupBy("sheet_id", F.col("path_id").cast("long").alias("path_id")).agg(F.count("*").alias("n"))
