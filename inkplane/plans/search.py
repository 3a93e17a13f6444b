"""Similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from . import views
from .registry import query

_UNIT = f"with {views.SKETCH}, u as (select name, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) as u from sketch)"
_BEST = f"{_UNIT} select c.name, round(max(list_dot_product(q.u, c.u)), 6) as score from u q join u c on q.name = 's0' group by c.name"


def _rounded(df):
    return df.select("name", F.round("score", 6).alias("score"))


@query(_BEST)
def sim_best_pair(spark, d):
    return _rounded(search.best_pair(views.sketch(spark, d), "s0"))


@query(f"{_UNIT} select c.name, round(avg(list_dot_product(q.u, c.u)), 6) as score from u q join u c on q.name = 's0' group by c.name")
def sim_mean_pair(spark, d):
    return _rounded(search.mean_pair(views.sketch(spark, d), "s0"))


@query(f"""with {views.SKETCH}, e as (select name, unnest(vec) as x, generate_subscripts(vec, 1) as pos from sketch),
m as (select name, pos, avg(x) as x from e group by all), v as (select name, list(x order by pos) as v from m group by name)
select c.name, round(list_cosine_similarity(q.v, c.v), 6) as score from v q join v c on q.name = 's0'""")
def sim_mean_embedding(spark, d):
    return _rounded(search.mean_embedding(views.sketch(spark, d), "s0"))


@query(f"select name, score from ({_BEST}) order by score desc, name limit 5")
def sim_topk(spark, d):
    return _rounded(search.similar(views.sketch(spark, d), "s0", digits=6))


@query(f"with {views.SKETCH}, n as (select name, count(*) as n from sketch group by 1) select count(*) as sketches, sum(n)::bigint as views, min(n) as least, max(n) as most from n")
def embed_summary(spark, d):
    return search.summary(views.sketch(spark, d))
