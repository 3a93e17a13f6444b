"""Queries on detections and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import detections
from . import views
from .registry import query

_PAIR = """greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0))::double * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0))"""
_IOU = f"(({_PAIR}) / ((p.x1 - p.x0) * (p.y1 - p.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) - ({_PAIR})))"


@query(f"with {views.DET} select p.sheet, p.id as a, q.id as b, round({_IOU}, 6) as iou from det p join det q on p.sheet = q.sheet and p.id < q.id where {_IOU} > 0.3")
def box_iou_pairs(spark, d):
    return detections.overlaps(views.det(spark, d), 0.3).withColumn("iou", F.round("iou", 6))


@query(f"""with {views.DET}, r as (select p.sheet, p.id, q.id as parent, ({_PAIR}) / ((p.x1 - p.x0) * (p.y1 - p.y0)) as share from det p join det q
on p.sheet = q.sheet and p.id <> q.id and (q.x1 - q.x0) * (q.y1 - q.y0) > (p.x1 - p.x0) * (p.y1 - p.y0))
select sheet, id, parent, round(share, 6) as share from r where share > 0.5 qualify row_number() over (partition by sheet, id order by share desc, parent) = 1""")
def box_inside_merge(spark, d):
    return detections.containers(views.det(spark, d)).withColumn("share", F.round("share", 6))


@query(f"""with recursive {views.DET}, r as (select *, row_number() over (partition by sheet order by conf desc, id) as rn from det),
c as (select q.sheet, q.rn, coalesce(list(p.rn) filter (where p.rn is not null), []) as foes from r q left join r p on p.sheet = q.sheet and p.rn < q.rn and {_IOU} > 0.3 group by 1, 2),
w as (select sheet, 0::bigint as rn, []::bigint[] as kept from (select distinct sheet from r) union all
select w.sheet, c.rn, case when list_has_any(w.kept, c.foes) then w.kept else list_append(w.kept, c.rn) end from w join c on c.sheet = w.sheet and c.rn = w.rn + 1),
k as (select sheet, unnest(kept) as rn from w where rn = (select max(rn) from c where c.sheet = w.sheet))
select r.sheet, r.id from k join r using (sheet, rn)""")
def nms_keep(spark, d):
    return detections.suppress(views.det(spark, d), 0.3)


@query("""select doc_id, count(*)::bigint as lines, count(*) filter (where regexp_matches(line, '[\\p{L}\\p{N}]'))::bigint as readable
from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by doc_id""")
def text_alnum_filter(spark, d):
    lines = views.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(F.when(detections.has_alnum(F.col("line")), 1)).alias("readable"))


def _tiled(spark, d):
    """Detections in one of four overlapping tiles of 400 x 320 with the zones that part the sheet."""
    det = views.det(spark, d).withColumn("tile_id", (F.col("id") % 4).cast("int"))
    rows = [(0, 0, 0, 0.0, 0.0, 350.0, 250.0), (1, 300, 0, 350.0, 0.0, 750.0, 250.0), (2, 0, 200, 0.0, 250.0, 350.0, 520.0), (3, 300, 200, 350.0, 250.0, 750.0, 520.0)]
    zones = det.select("sheet").distinct().crossJoin(F.broadcast(spark.createDataFrame(rows, "tile_id int, tx int, ty int, zx0 double, zy0 double, zx1 double, zy1 double")))
    return det, zones


@query(f"""with {views.DET}, z(tile_id, tx, ty, zx0, zy0, zx1, zy1) as (values (0, 0, 0, 0.0, 0.0, 350.0, 250.0), (1, 300, 0, 350.0, 0.0, 750.0, 250.0), (2, 0, 200, 0.0, 250.0, 350.0, 520.0), (3, 300, 200, 350.0, 250.0, 750.0, 520.0)),
c as (select d.sheet, d.id, z.*, tx + (x0 + x1) / 2.0 as cx, ty + (y0 + y1) / 2.0 as cy from det d join z on d.id % 4 = z.tile_id where conf >= 25)
select sheet, id, tile_id from c where cx >= zx0 and cx < zx1 and cy >= zy0 and cy < zy1""")
def conf_zone_filter(spark, d):
    return detections.in_own_zone(*_tiled(spark, d), 25.0).select("sheet", "id", "tile_id")


@query("select count(*) filter (where value <= 400)::bigint as ok, count(*) filter (where value > 400)::bigint as failed, case when count(*) filter (where value > 400) > 0 then 1 else 0 end as exit_code from events")
def batch_status(spark, d):
    return detections.status(views.table(spark, d, "events").select(F.when(F.col("value") > 400, "too large").alias("error")))


@query(f"""with {views.DET}, s as (select *, case id % 3 when 0 then 0.5 when 1 then 1.0 else 2.0 end as scale from det)
select id, greatest(0, floor(x0 / scale))::bigint as x0, greatest(0, floor(y0 / scale))::bigint as y0, least(900, ceil(x1 / scale))::bigint as x1, least(700, ceil(y1 / scale))::bigint as y1 from s""")
def box_to_orig(spark, d):
    scale = F.element_at(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), (F.col("id") % 3 + 1).cast("int"))
    b = B.to_original(B.box("x0", "y0", "x1", "y1"), scale, F.lit(900), F.lit(700))
    return views.det(spark, d).select("id", b.alias("b")).select("id", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])
