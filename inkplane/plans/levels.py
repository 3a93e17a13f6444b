"""Queries on levels and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels, profiles
from . import views
from .registry import query


def _r(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def _rgb(spark, d):
    p = views.px(spark, d).withColumn("pos", F.col("y") * 8 + F.col("x"))
    shifted = lambda k, name: p.select("sheet_id", F.pmod(F.col("pos") - k, F.lit(64)).alias("pos"), F.col("v").alias(name))
    return p.select("sheet_id", "y", "x", "pos", F.col("v").alias("r")).join(shifted(21, "g"), ["sheet_id", "pos"]).join(shifted(42, "b"), ["sheet_id", "pos"])


_RGB = f"""{views.PX}, rgb as (select p.sheet_id, p.y, p.x, p.v as r, g.v as g, b.v as b from px p
join px g on g.sheet_id = p.sheet_id and g.y * 8 + g.x = (p.y * 8 + p.x + 21) % 64 join px b on b.sheet_id = p.sheet_id and b.y * 8 + b.x = (p.y * 8 + p.x + 42) % 64)"""


@query(f"with {_RGB} select sheet_id, y::int as y, x::int as x, least(r, g, b) as v from rgb")
def gray_min(spark, d):
    return levels.gray(_rgb(spark, d))


_OTSU = f"""{views.PX}, h as (select sheet_id, v, count(*) as n from px group by all), c as (select sheet_id, v, sum(n) over k as n0, sum(n * v) over k as s0, sum(n) over (partition by sheet_id) as n, sum(n * v) over (partition by sheet_id) as s
from h window k as (partition by sheet_id order by v)), o as (select sheet_id, v as threshold from c qualify row_number() over (partition by sheet_id order by case when n > n0 then pow((s0 * n - s * n0)::double, 2) / (n0::double * (n - n0)) else 0 end desc, v) = 1)"""


@query(f"with {_OTSU} select sheet_id, threshold from o")
def otsu_threshold(spark, d):
    return levels.otsu(views.px(spark, d))


@query(f"with {_OTSU} select sheet_id, y::int as y, x::int as x, case when v <= threshold then 255 else 0 end as v from px join o using (sheet_id)")
def binarize(spark, d):
    return levels.binarize(views.px(spark, d))


@query(f"""with {views.PROFILE}, b as (select path, round_even(t, 0) as bin, count(*) as n, avg(t) as mean from profile group by all), s as (select *, sum(n) over (partition by path) as total from b)
select path, round(coalesce(arg_max(mean, bin) filter (where n >= 0.06 * total), arg_max(mean, n * 100000 - bin)), 6) as thickness from s group by path""")
def thickness_hump(spark, d):
    return _r(levels.thickness_hump(views.profile(spark, d)), "thickness")


_KDE = f"""{views.LEVEL}, l as (select ln(lvl) as u, lvl, w from level), e as (select min(u) - 0.15 as lo, max(u) + 0.15 as hi from l),
g as (select i, lo + i * (hi - lo) / 599 as g from e, range(600) r(i)), k as (select i, g, sum(w * exp(-pow((g - u) / 0.05, 2) / 2)) as raw from g, l group by all),
a as (select i, exp(g) as "at", raw, (raw + lag(raw) over (order by i)) / 2 * (exp(g) - lag(exp(g)) over (order by i)) as part from k), dens as (select i, "at", raw / sum(part) over () as dens from a)"""


@query(f"""with {_KDE} select i::int as i, round("at", 6) as "at", round(dens, 6) as dens from dens""")
def kde_density(spark, d):
    return _r(levels.density(views.level(spark, d)), "at", "dens")


_PEAKS = f"""{_KDE}, n as (select *, lag(dens) over (order by i) as up, lead(dens) over (order by i) as down from dens), t as (select * from n where dens > up and dens > down),
side as (select t.i, t."at", t.dens, coalesce((select max(i) from dens x where x.i < t.i and x.dens > t.dens), -1) as a, coalesce((select min(i) from dens x where x.i > t.i and x.dens > t.dens), 600) as b from t),
p as (select s.i, s."at", s.dens, s.dens - greatest((select min(dens) from dens x where x.i > s.a and x.i <= s.i), (select min(dens) from dens x where x.i < s.b and x.i >= s.i)) as prominence from side s),
peak as (select *, prominence >= 0.05 * max(dens) over () as significant from p)"""


@query(f"""with {_PEAKS} select i::int as i, round("at", 6) as "at", round(dens, 6) as dens, round(prominence, 6) as prominence, significant from peak""")
def kde_peaks(spark, d):
    return _r(levels.peaks(levels.density(views.level(spark, d))), "at", "dens", "prominence")


_VALLEYS = f"""{_PEAKS}, gap as (select i as i0, lead(i) over (order by i) as i1 from peak where significant), valley as (select i0, i1, arg_min("at", dens) as valley_at from gap join dens on i > i0 and i < i1 where i1 is not null group by all)"""


def _valleys(spark, d):
    dens = levels.density(views.level(spark, d))
    tops = levels.peaks(dens)
    return tops, levels.valleys(dens, tops)


@query(f"""with {_VALLEYS}, near as (select i, "at" from peak where significant order by abs("at" - 20), i limit 1) select round("at", 6) as peak, round(valley_at, 6) as threshold from near left join valley on near.i = i1""")
def kde_valley_threshold(spark, d):
    return _r(levels.threshold(*_valleys(spark, d), 20.0), "peak", "threshold")


@query(f"""with {_VALLEYS}, h as (select (select count(*) from valley where valley_at <= lvl) as hump, sum(w) as m from level group by all) select hump::int as hump, round(m / sum(m) over (), 6) as mass from h""")
def hump_mass(spark, d):
    return _r(levels.hump_masses(views.level(spark, d), _valleys(spark, d)[1]), "mass")


@query("""with v as (select l_returnflag as flag, l_quantity as q, sum(l_extendedprice::decimal(18,2)) as w from lineitem group by all), c as (select *, sum(w) over (partition by flag order by q) as c, sum(w) over (partition by flag) as t from v)
select flag, min(q) as median from c where c >= t / 2 group by flag""")
def weighted_median(spark, d):
    l = views.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("w"))
    return levels.weighted_median(l, "q", "w", ["flag"])


@query("""with v as (select l_returnflag as flag, l_quantity as q, sum(l_extendedprice) as w from lineitem group by all),
c as (select flag, q, sum(w) over k as w0, sum(w * q) over k as m0, sum(w) over (partition by flag) as w, sum(w * q) over (partition by flag) as m, lead(q) over k as nx from v window k as (partition by flag order by q)),
b as (select flag, q, w0 * (w - w0) / (w * w) * pow(m0 / w0 - (m - m0) / (w - w0), 2) as b from c where nx is not null)
select flag, q as threshold, round(b, 6) as "between" from b qualify row_number() over (partition by flag order by round(b, 9) desc, q) = 1""")
def weighted_otsu(spark, d):
    l = views.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("w"))
    return _r(levels.weighted_otsu(l, "q", "w", ["flag"]), "between")


_HALVES = "(select min(v) from (select v, sum(w) over (order by v) as c, sum(w) over () as t from (select unnest(vs, recursive := true)) where v {} cut) where c >= t / 2)"


@query(f"""with recursive v as (select l_returnflag as flag, l_quantity::double as v, sum(l_extendedprice)::double as w from lineitem group by all),
c as (select flag, v as q, sum(w) over k as w0, sum(w * v) over k as m0, sum(w) over (partition by flag) as w, sum(w * v) over (partition by flag) as m, lead(v) over k as nx from v window k as (partition by flag order by v)),
o as (select flag, q as cut from (select flag, q, w0 * (w - w0) / (w * w) * pow(m0 / w0 - (m - m0) / (w - w0), 2) as b from c where nx is not null) qualify row_number() over (partition by flag order by round(b, 9) desc, q) = 1),
vs as (select flag, list({{'v': v, 'w': w}} order by v) as vs from v group by flag),
r(flag, vs, cut, low, high, k) as (select flag, vs, cut, null::double, null::double, 0 from vs join o using (flag) union all
  select flag, vs, (lo + hi) / 2, lo, hi, k + 1 from (select flag, vs, cut, k, {_HALVES.format("<=")} as lo, {_HALVES.format(">")} as hi from r where k < 20 and (low is null or (low + high) / 2 = cut)))
select flag, low, high, cut as threshold from r qualify row_number() over (partition by flag order by k desc) = 1""")
def two_medians(spark, d):
    l = views.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("w"))
    return levels.two_medians(l, "q", "w", ["flag"])


@query(f"with {views.PROFILE}, m as (select *, median(t) over (partition by path) as m from profile) select path, round(any_value(m), 6) as median, round(median(abs(t - m)) * 1.4826, 6) as mad from m group by path")
def mad_by_group(spark, d):
    return _r(levels.mad(views.profile(spark, d), "t", ["path"]), "median", "mad")


_SPOTS = f"""{views.PROFILE}, small as (select path, ord, t / 40 as t, deg from profile),
spot as (select p.*, exists (select 1 from small j where j.path = p.path and j.deg >= 3 and abs(j.ord - p.ord) <= ceil(j.t / 2)) as spot from small p)"""


def _thin(spark, d):
    return views.profile(spark, d).withColumn("t", F.col("t") / 40)


@query(f"with {_SPOTS} select path, ord::bigint as ord, spot from spot")
def junction_spots(spark, d):
    return profiles.junction_spots(_thin(spark, d)).select("path", F.col("ord").cast("long").alias("ord"), "spot")


@query(f"""with {_SPOTS}, n as (select *, last_value(case when not spot then ord end ignore nulls) over (partition by path order by ord rows between unbounded preceding and current row) as a,
first_value(case when not spot then ord end ignore nulls) over (partition by path order by ord rows between current row and unbounded following) as b from spot)
select n.path, n.ord::bigint as ord, round(case when not n.spot then n.t else coalesce(p.t + (q.t - p.t) * (n.ord - n.a) / (n.b - n.a), p.t, q.t, n.t) end + 1e-9, 6) as t
from n left join small p on p.path = n.path and p.ord = n.a left join small q on q.path = n.path and q.ord = n.b""")
def junction_interp(spark, d):
    free = profiles.junction_free(profiles.junction_spots(_thin(spark, d)))
    return _r(free.withColumn("t", F.col("t") + 1e-9), "t").withColumn("ord", F.col("ord").cast("long"))


_RUNS = f"""{views.PROFILE}, f as (select path, ord, t > 20 as o from profile), r as (select *, ord - row_number() over (partition by path, o order by ord) as run from f),
closed as (select path, ord, o or count(*) over (partition by path, o, run) < 3 as o from r)"""


def _flags(spark, d):
    return views.profile(spark, d).select("path", "ord", (F.col("t") > 20).alias("on"))


@query(f'with {_RUNS} select path, ord::bigint as ord, o as "on" from closed')
def close_runs(spark, d):
    return profiles.close_runs(_flags(spark, d), 3).withColumn("ord", F.col("ord").cast("long"))


@query(f"""with {_RUNS}, k as (select path, min(ord) filter (where not o) as lo, max(ord) filter (where not o) as hi, max(ord) as last from closed group by path)
select path, (case when path % 2 = 0 then lo else 0 end)::bigint as a, (case when path % 3 = 0 then hi else last end + 1)::bigint as b from k where lo is not null""")
def trim_span(spark, d):
    t = profiles.trim(_flags(spark, d), F.col("path") % 2 == 0, F.col("path") % 3 == 0, 3)
    return t.select("path", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query(f"""with {views.PROFILE}, l as (select path, ord, ln(greatest(t / 20, 1)) as l from profile), m as (select path, ceil(3 * exp(median(l))) as m from l group by path),
c as (select l.path, ord as i, m, count(*) over (partition by l.path) as n, sum(l) over (partition by l.path) as s, sum(l) over (partition by l.path order by ord rows between unbounded preceding and 1 preceding) as si from l join m using (path)),
g as (select path, i, abs(si / i - (s - si) / (n - i)) as gap, n from c where i >= m and n - i >= m), b as (select *, round(sqrt(i * (n - i) / n::double) * gap, 9) as score from g)
select path, i::bigint as cut, round(score, 6) as score, round(gap, 6) as gap, gap > ln(1.3) as worth from b qualify row_number() over (partition by path order by score desc, i) = 1""")
def level_cut_once(spark, d):
    p = views.profile(spark, d).withColumn("t", F.col("t") / 20)
    return _r(profiles.best_cut(p), "score", "gap").withColumn("cut", F.col("cut").cast("long"))


_CUTS = f"""{views.PROFILE}, l as (select path, row_number() over (partition by path order by ord) as i, ln(greatest(t / 20, 1)) as l from profile),
ls as (select path, list(l order by i) as ls from l group by path),
piece(path, ls, a, b, cut) as (select path, ls, 0::bigint, len(ls)::bigint, null::bigint from ls
  union all
  select path, ls, unnest([a, a - e.k]), unnest([a - e.k, b]), a - e.k from (select path, ls, a, b, list_aggregate(list_transform(list_filter(range(1, n), lambda i: i >= m and n - i >= m),
      lambda i: {{'s': round(sqrt(i * (n - i) / n::double) * abs(list_sum(x[1:i]) / i - list_sum(x[i + 1:]) / (n - i)), 9), 'k': -i, 'g': abs(list_sum(x[1:i]) / i - list_sum(x[i + 1:]) / (n - i))}}), 'max') as e
    from (select path, ls, a, b, ls[a + 1 : b] as x, b - a as n, ceil(3 * exp(list_aggregate(ls[a + 1 : b], 'median'))) as m from piece)) where e.g > ln(1.3))"""


@query(f"with recursive {_CUTS} select distinct path, cut from piece where cut is not null")
def level_cuts_full(spark, d):
    return profiles.level_cuts(views.profile(spark, d).withColumn("t", F.col("t") / 20))


@query(f"""with {views.PROFILE}, b as (select path, ord // 10 as branch, sum(ln(greatest(t, 1))) as s, count(*) as n from profile group by all), r as (select *, sum(s) over (partition by path) - s as rs, sum(n) over (partition by path) - n as rn from b)
select path, branch::bigint as branch, round(abs(s / n - rs / rn), 6) as gap, abs(s / n - rs / rn) > ln(1.3) as cut from r where rn > 0""")
def branch_cuts(spark, d):
    return _r(profiles.branch_cuts(views.profile(spark, d).withColumn("branch", F.floor(F.col("ord") / 10))), "gap")


@query(f"with {views.PROFILE} select path, greatest(2, round_even(quantile_cont(t, 0.25) / 2, 0))::int as k from profile group by path")
def dir_scale_p25(spark, d):
    return profiles.direction_scale(views.profile(spark, d))


@query(f"with {views.PROFILE} select path, round(exp(avg(ln(greatest(t, 1)))), 6) as level from profile group by path")
def geo_mean_level(spark, d):
    return _r(profiles.geometric_level(views.profile(spark, d)), "level")


@query(f"with {views.PROFILE} select path, (ceil(2 * median(t)) + 1)::int as width from profile group by path")
def stroke_width(spark, d):
    return profiles.stroke_width(views.profile(spark, d))


_POINTS = f"{views.PROFILE}, pt as (select path, ord, (path % 40 + ord * (path % 3))::double as y, (50 + 20 * sin(round(ord / 9.0, 6)))::double as x from profile)"


def _points(spark, d):
    return views.profile(spark, d).select("path", "ord", (F.col("path") % 40 + F.col("ord") * (F.col("path") % 3)).cast("double").alias("y"), (50 + 20 * F.sin(F.round(F.col("ord") / 9.0, 6))).alias("x"))


@query(f"""with {_POINTS}, s as (select *, sqrt(pow(y - lag(y) over k, 2) + pow(x - lag(x) over k, 2)) as step from pt window k as (partition by path order by ord)),
e as (select path, coalesce(sum(step), 0) as length, max(y) - min(y) as eh, max(x) - min(x) as ew from s group by path) select path, round(length, 6) as length, round(eh, 6) as eh, round(ew, 6) as ew, eh >= 90 or ew >= 90 as frame from e""")
def frame_predicate(spark, d):
    return _r(profiles.is_frame(profiles.extents(_points(spark, d)), 100, 100), "length", "eh", "ew")


@query(f"""with {_POINTS}, m as (select path, avg(x) as mx, avg(y) as my from pt where path % 3 > 0 group by path), p as (select path, mx, my, x - mx as u, y - my as v from pt join m using (path)),
s as (select path, any_value(mx) as mx, any_value(my) as my, count(*) as n, sum(u * u) as uu, sum(v * v) as vv, sum(u * v) as uv, (sum(u * u * u) + sum(u * v * v)) / 2 as a, (sum(v * v * v) + sum(v * u * u)) / 2 as b from p group by path),
c as (select *, (a * vv - b * uv) / (uu * vv - uv * uv) as cu, (b * uu - a * uv) / (uu * vv - uv * uv) as cv from s)
select path, round(mx + cu, 4) as cx, round(my + cv, 4) as cy, round(sqrt(cu * cu + cv * cv + (uu + vv) / n), 4) as r from c""")
def circle_fit_kasa(spark, d):
    return _r(profiles.fit_circle(_points(spark, d).where("path % 3 > 0")), "cx", "cy", "r", n=4)
