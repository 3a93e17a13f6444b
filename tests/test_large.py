"""What only larger tables or odd numbers show: results bit by bit, plans that send no table of rows to the driver."""

import datetime

import duckdb

import numpy as np
from pyspark.sql import functions as F

from inkplane import plans
from inkplane.llm import neighbours
from inkplane.operators import profiles, search, tiles


def _against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the tables given."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, want = plans.queries()[name](spark, str(folder)).toPandas(), c.sql(plans.oracle_sql()[name]).df()
    return sorted(map(repr, got[want.columns].values.tolist())), sorted(map(repr, want.values.tolist()))


def test_quartiles_beside_an_odd_number(spark, tmp_path):
    pairs = [(lo / 100, (odd * 400 - 3 * lo) / 100) for odd in (5, 7, 9, 21) for lo in range(odd * 100 - 400, odd * 100, 3)]
    at = datetime.datetime(2024, 1, 1)
    rows = [(2 * i + k, at, i, "view", v) for i, pair in enumerate(pairs) for k, v in enumerate(pair)] + [(10**6 + i, at, 10**6, "view", float(i)) for i in range(6)]
    got, want = _against_sql(spark, tmp_path, "dir_scale_p25", events=spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double"))
    assert got == want and len(got) == len(pairs) + 1


def test_quartile_of_nothing_and_of_one(spark):
    d = spark.createDataFrame([(0, None), (1, 7.0)], "path int, t double")
    assert {r.path: r.k for r in profiles.direction_scale(d).collect()} == {0: 2, 1: 4}


def _plan(df):
    """The plan that ran, as it was changed at run time."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_queries_are_not_broadcast(spark):
    x = np.random.default_rng(3).standard_normal((300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert "Broadcast" not in _plan(neighbours.search(rows, F.col("vec_id") % 100 == 0))


def _parts(spark, tmp_path):
    """Parts in a folder, as the queries on sheets read them."""
    spark.range(40).selectExpr("id as p_partkey", "cast(1 + id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_zones_are_not_broadcast(spark, tmp_path):
    assert "Broadcast" not in _plan(plans.queries()["tile_zones"](spark, _parts(spark, tmp_path)))


def test_areas_of_zones_are_not_broadcast(spark, tmp_path):
    assert "Broadcast" not in _plan(plans.queries()["zone_partition_check"](spark, _parts(spark, tmp_path)))


def test_target_pixels_are_not_broadcast(spark, tmp_path):
    d = spark.range(30).selectExpr("id as vec_id", "transform(sequence(0, 63), i -> cast(i * id % 17 / 34 - 0.25 as float)) as embedding")
    got, want = _against_sql(spark, tmp_path, "scale_lookup", embeddings=d)
    assert got == want
    assert "Broadcast" not in _plan(plans.queries()["scale_lookup"](spark, str(tmp_path)))


def test_pairs_of_views_are_products_of_blocks(spark):
    x = np.random.default_rng(5).standard_normal((90, 6))
    d = spark.createDataFrame([(f"s{i % 3}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "name string, vec array<double>")
    got = search.best_pair(d, "s0")
    assert "MapInArrow" in (plan := _plan(got)) and "Broadcast" not in plan
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {r["name"]: r.score and round(r.score, 9) for r in got.collect()} == {f"s{k}": round(float((u[k::3] @ u[::3].T).max()), 9) for k in range(3)} | {"none": None}
    assert search.best_pair(d, "nobody").count() == 0


def test_equal_scores_of_the_sql_go_by_name(spark, tmp_path):
    v = [float(1 + i) for i in range(5)]
    d = spark.createDataFrame([(i, [v[0] + 1e-5 * (6 - i), *v[1:]], (7 - i) % 7) for i in range(7)], "vec_id long, embedding array<double>, label int")  # cosines that are 1 to 6 digits
    got, want = _against_sql(spark, tmp_path, "sim_topk", embeddings=d)
    assert got == want and len(got) == 5


def test_views_of_one_size_and_place_go_by_number(spark):
    d = spark.createDataFrame([(0, i, 5, 5, 9, 9) for i in (3, 1, 4, 2, 0)], "sheet_id int, seg_id int, x0 int, y0 int, x1 int, y1 int")
    assert all(r.k == r.seg_id for r in tiles.order_views(d).collect())
