"""Queries on small rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rasters
from . import views
from .registry import query

_INK = f"{views.PX}, ink as (select sheet_id, y, x from px where v <= 128)"


def _ink(spark, d):
    return views.px(spark, d).where("v <= 128").select("sheet_id", "y", "x")


def _mask(spark, d):
    return views.px(spark, d).withColumn("v", F.when(F.col("v") <= 128, 255).otherwise(0))


@query(f"with {_INK}, g as (select *, x - row_number() over (partition by sheet_id, y order by x) as g from ink) select sheet_id, y::int as y, min(x)::int as x0, (max(x) + 1)::int as x1 from g group by sheet_id, y, g")
def px_runs(spark, d):
    return rasters.runs(_ink(spark, d))


@query(f"with {_INK}, g as (select *, x - row_number() over (partition by sheet_id, y order by x) as g from ink), k as (select *, count(*) over (partition by sheet_id, y, g) as n from g) select sheet_id, y::int as y, x::int as x from k where n >= 3")
def px_open_lines(spark, d):
    return rasters.open_lines(_ink(spark, d), 3)


def _flood(ink: str, near: str) -> str:
    return f"""reach(sheet_id, p, r) as (select sheet_id, y * 8 + x, y * 8 + x from {ink} union select r.sheet_id, i.y * 8 + i.x, r.r from reach r join {ink} i on i.sheet_id = r.sheet_id and {near}),
cc as (select sheet_id, p, min(r) as component from reach group by all)"""


_NEAR8 = "abs(i.y - r.p // 8) <= 1 and abs(i.x - r.p % 8) <= 1"
_NEAR4 = "abs(i.y - r.p // 8) + abs(i.x - r.p % 8) <= 1"


@query(f"with recursive {_INK}, {_flood('ink', _NEAR8)} select sheet_id, (p // 8)::int as y, (p % 8)::int as x, component::bigint as component from cc")
def px_components(spark, d):
    return rasters.components(_ink(spark, d), 8).select("sheet_id", F.col("y").cast("int").alias("y"), "x", F.col("component").cast("long").alias("component"))


@query(f"with recursive {_INK}, {_flood('ink', _NEAR8)} select sheet_id, component::bigint as component, count(*)::bigint as area, min(p % 8)::int as x, min(p // 8)::int as y, (max(p % 8) - min(p % 8) + 1)::int as w, (max(p // 8) - min(p // 8) + 1)::int as h from cc group by all")
def px_component_stats(spark, d):
    return rasters.component_stats(rasters.components(_ink(spark, d), 8)).withColumn("component", F.col("component").cast("long")).withColumn("y", F.col("y").cast("int")).withColumn("h", F.col("h").cast("int"))


@query(f"with recursive {views.PX}, bg as (select sheet_id, y, x from px where v > 128), {_flood('bg', _NEAR4)} select sheet_id, component::bigint as component, count(*)::bigint as area from cc group by all having not bool_or(p // 8 in (0, 7) or p % 8 in (0, 7))")
def px_holes(spark, d):
    return rasters.holes(_mask(spark, d), 8, 8).select("sheet_id", F.col("component").cast("long").alias("component"), "area")


@query(f"with {_INK}, bg as (select sheet_id, y, x from px where v > 128) select i.sheet_id, i.y::int as y, i.x::int as x, round(sqrt(min(pow(i.y - b.y, 2) + pow(i.x - b.x, 2))), 6) as dist from ink i left join bg b using (sheet_id) group by i.sheet_id, i.y, i.x")
def px_edt(spark, d):
    return rasters.distances(_mask(spark, d)).withColumn("dist", F.round("dist", 6))


_RING = "(values (0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, -1), (6, 0, -1), (7, -1, -1)) r(k, dy, dx)"


@query(f"""with {_INK}, n as (select i.sheet_id, i.y, i.x, r.k, (j.y is not null)::int as p from ink i cross join {_RING} left join ink j on j.sheet_id = i.sheet_id and j.y = i.y + r.dy and j.x = i.x + r.dx),
l as (select sheet_id, y, x, list(p order by k) as p from n group by all),
t as (select *, list_sum(p) as n, list_sum(list_transform(range(8), lambda k: (1 - p[k + 1]) * p[(k + 1) % 8 + 1])) as turns from l)
select sheet_id, y::int as y, x::int as x from t where not (n between 2 and 6 and turns = 1 and p[1] * p[3] * p[5] = 0 and p[3] * p[5] * p[7] = 0)""")
def px_thin_once(spark, d):
    return rasters.thin_once(_ink(spark, d))


@query(f"with {views.PX} select sheet_id, y::int as y, x::int as x, (case when (y + x) % 3 = 0 then v else 255 - floor((255 - v) / 4) end)::int as v from px")
def px_fade(spark, d):
    p = views.px(spark, d)
    return rasters.fade(p, p.where("(y + x) % 3 = 0"))


@query(f"with {views.PX} select sheet_id, y::int as y, x::int as x, case when (y + x) % 3 = 0 then v else 255 end as v from px")
def px_clean(spark, d):
    p = views.px(spark, d)
    return rasters.under_mask(p, p.where("(y + x) % 3 = 0"))
