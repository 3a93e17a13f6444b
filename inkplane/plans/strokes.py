"""Queries on lines by their sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import strokes
from . import views
from .registry import query

_POINTS = f"{views.PROFILE}, pt as (select path, ord, (path % 40 + ord * (path % 3))::double as y, (50 + 20 * sin(round(ord / 9.0, 6)))::double as x, 1 + ord % 4 + 0.25 as dist, deg from profile)"


def _points(spark, d):
    y = (F.col("path") % 40 + F.col("ord") * (F.col("path") % 3)).cast("double")
    return views.profile(spark, d).select("path", "ord", y.alias("y"), (50 + 20 * F.sin(F.round(F.col("ord") / 9.0, 6))).alias("x"), (1 + F.col("ord") % 4 + 0.25).alias("dist"), "deg")


@query(f"""with {_POINTS}, n as (select path, max(ord) as last from pt group by path), v as (select p.path, p.ord, b.y - a.y as dy, b.x - a.x as dx from pt p join n using (path)
  join pt a on a.path = p.path and a.ord = greatest(p.ord - 3, 0) join pt b on b.path = p.path and b.ord = least(p.ord + 3, last))
select path, ord::bigint as ord, round(dy / greatest(sqrt(dy * dy + dx * dx), 1e-9), 6) + 0.0 as ty, round(dx / greatest(sqrt(dy * dy + dx * dx), 1e-9), 6) + 0.0 as tx from v""")
def line_tangents(spark, d):
    t = strokes.tangents(_points(spark, d))
    return t.select("path", F.col("ord").cast("long").alias("ord"), (F.round("ty", 6) + 0.0).alias("ty"), (F.round("tx", 6) + 0.0).alias("tx"))


@query(f"""with {_POINTS}, n as (select path, max(ord) as last, arg_min(deg, ord) as d0, arg_max(deg, ord) as d1, arg_min(dist, ord) as r0, arg_max(dist, ord) as r1 from pt group by path)
select path, ord::bigint as ord, ord >= case when d0 >= 3 then ceil(r0) else 0 end and last - ord >= case when d1 >= 3 then ceil(r1) else 0 end as clear from pt join n using (path)""")
def junction_mask(spark, d):
    return strokes.off_junctions(_points(spark, d)).select("path", F.col("ord").cast("long").alias("ord"), "clear")


@query(f"""with {_POINTS}, s as (select path, side, case side when 0 then ord else last - ord end as k, y, x, dist, last from pt join (select path, max(ord) as last from pt group by path) using (path), (values (0), (1)) v(side)),
f as (select path, side, last, least(ceil(dist), last) as near from s where k = 0), g as (select *, least(near + 6, last) as far from f), h as (select path, side, case when far - near < 6 then 0 else near end as a, case when far - near < 6 then last else far end as b from g),
v as (select h.path, h.side, p.y - q.y as vy, p.x - q.x as vx from h join s p on p.path = h.path and p.side = h.side and p.k = h.a join s q on q.path = h.path and q.side = h.side and q.k = h.b), n as (select *, sqrt(vy * vy + vx * vx) as n from v)
select path, side, case when n > 0 then round(vy / n, 6) + 0.0 else 0 end::double as dy, case when n > 0 then round(vx / n, 6) + 0.0 else 0 end::double as dx, case when n > 0 then round(degrees(atan(1 / n)), 6) else 180 end::double as err from n""")
def end_directions(spark, d):
    e = strokes.end_directions(_points(spark, d))
    return e.select("path", "side", (F.round("dy", 6) + 0.0).alias("dy"), (F.round("dx", 6) + 0.0).alias("dx"), F.round("err", 6).alias("err"))


_ENDS = f"{views.ENDS}, e as (select id, node as junc, id // 3 as branch, dy, dx, (len % 7)::double as err, case when len % 11 = 0 then null else len / 4.0 end as thickness, len / 30.0 as thickness_std, id % 6 as n_sect, len as length from ends)"
_TURN = "degrees(acos(greatest(-1, least(1, -(p.dy * q.dy + p.dx * q.dx)))))"
_PAIR = f"""{_ENDS}, pair as (select p.junc, p.id as a, q.id as b, round({_TURN} + sqrt(p.err * p.err + q.err * q.err), 6) as score from e p join e q on p.junc = q.junc and p.id < q.id and p.branch <> q.branch
  and {_TURN} <= 10 + sqrt(p.err * p.err + q.err * q.err) and coalesce(abs(p.thickness - q.thickness) <= 1 + sqrt(pow(greatest(p.thickness_std, 0.5), 2) + pow(greatest(q.thickness_std, 0.5), 2)), true)),
r as (select *, row_number() over (partition by junc order by score, a, b) as rn from pair),
w as (select junc, 0::bigint as rn, []::bigint[] as used, []::bigint[] as kept from (select distinct junc from r) union all
  select w.junc, r.rn, case when list_has_any(w.used, [r.a, r.b]) then w.used else list_concat(w.used, [r.a, r.b]) end, case when list_has_any(w.used, [r.a, r.b]) then w.kept else list_append(w.kept, r.rn) end
  from w join r on r.junc = w.junc and r.rn = w.rn + 1), k as (select junc, unnest(kept) as rn from w where rn = (select max(rn) from r where r.junc = w.junc)), m as (select r.* from k join r using (junc, rn))"""


def _ends(spark, d):
    return views.ends(spark, d).selectExpr("id", "node as junc", "id div 3 as branch", "dy", "dx", "cast(len % 7 as double) as err", "if(len % 11 = 0, null, len / 4) as thickness", "len / 30 as thickness_std", "id % 6 as n_sect", "len as length")


@query(f"with recursive {_PAIR} select junc, a, b, score::double as score from m")
def junction_pairs(spark, d):
    return strokes.junction_pairs(_ends(spark, d), 0.5)


_LINE = f"""{_ENDS}, b as (select id, id // 4 as line, thickness, n_sect, length from e), v as (select line, thickness, sum(n_sect) as w from b where thickness is not null and n_sect > 0 group by all),
c as (select *, sum(w) over (partition by line order by thickness) as c, sum(w) over (partition by line) as t from v), md as (select line, min(thickness) as thickness from c where c >= t / 2 group by line),
ln as (select line, sum(length)::bigint as length, any_value(md.thickness) as thickness from b left join md using (line) group by line)"""


def _lines(spark, d):
    return _ends(spark, d).withColumn("line", F.expr("id div 4"))


@query(f"with {_LINE} select line, length, round(coalesce(thickness, -1), 6)::double as thickness from ln")
def line_thickness(spark, d):
    return strokes.line_thickness(_lines(spark, d)).select("line", "length", F.round(F.coalesce("thickness", F.lit(-1.0)), 6).cast("double").alias("thickness"))


@query(f"""with recursive {_PAIR}, {_LINE.removeprefix(_ENDS + ", ")}, th as (select distinct junc, unnest([a, b]) as id from m),
o as (select e.junc, e.id // 4 as line, ln.thickness, th.id is not null as through, bool_or(th.id is not null) over (partition by e.junc) as anyone from e left join th on th.junc = e.junc and th.id = e.id join ln on ln.line = e.id // 4)
select junc, coalesce(arg_max(line, thickness * 1e6 - line) filter (where thickness is not null), -1)::bigint as line from o where through or not anyone group by junc""")
def junction_line(spark, d):
    ends = _lines(spark, d)
    return strokes.junction_lines(ends, strokes.junction_pairs(ends, 0.5), strokes.line_thickness(ends))


@query(f"""with {views.PX}, l as (select distinct sheet_id, k as id, (sheet_id + k) % 3 as x, (sheet_id * 3 + 4 * k) % 8 as y, 3 + k as w, 1 + k % 2 as h from px, (values (0), (1), (2)) v(k)), c as (select sheet_id, x, min(y) as top, max(y) as bottom from px where v < 60 group by all),
u as (select l.sheet_id, id, min(top) as top, max(bottom) as bottom from l join c on c.sheet_id = l.sheet_id and c.x >= l.x and c.x < l.x + w group by all)
select l.sheet_id, id, coalesce(top >= y - h or bottom <= y + 2 * h - 1, true) as edge from l left join u using (sheet_id, id)""")
def edge_lines(spark, d):
    p = views.px(spark, d)
    l = p.select("sheet_id").distinct().selectExpr("sheet_id", "explode(array(0, 1, 2)) as id").selectExpr("sheet_id", "id", "(sheet_id + id) % 3 as x", "(sheet_id * 3 + 4 * id) % 8 as y", "3 + id as w", "1 + id % 2 as h")
    return strokes.edge_lines(l, p.where("v < 60")).select("sheet_id", "id", "edge")
