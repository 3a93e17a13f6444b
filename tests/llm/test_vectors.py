import numpy as np
import pytest
from pyspark.sql import functions as F

from inkplane.llm import components, neighbours, vector_dedup

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")
ODD = [(1001, None), (1002, [0.0] * 8), (1003, [NAN] + [1.0] * 7), (1004, [INF] + [1.0] * 7), (1005, [None] + [1.0] * 7), (1006, []), (1007, [1.0, 0.0]), (1008, [2.0, 0.0]), (None, [1.0] * 8), (1100, None)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 8))
    x[300:420] = x[299] + 0.03 * rng.standard_normal((120, 8))
    x[430:440] = x[429] * np.arange(1, 11)[:, None]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))] + ODD
    rows += [rows[5], rows[5]]
    return spark.createDataFrame([(v, i, "z") for i, v in rows], "embedding array<float>, vec_id long, component string"), rows


def _links(rows):
    whole = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(whole)
    out = {i: set() for i, _ in rows if i is not None}
    for i in ids:
        for j in ids:
            if i < j and len(whole[i]) == len(whole[j]) and whole[i] @ whole[j] / np.linalg.norm(whole[i]) / np.linalg.norm(whole[j]) >= 0.95:
                out[i].add(j)
                out[j].add(i)
    return out


def test_near_duplicates_are_those_of_brute_force(vectors):
    df, rows = vectors
    links = _links(rows)
    label = {i: i for i in links}
    for _ in range(30):
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
    got = vector_dedup.near_duplicates(df).collect()
    assert len(got) == len(links) + 1
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), label[r.vec_id], label[r.vec_id] == r.vec_id), r


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.standard_normal(6) + 0.02 * rng.standard_normal((100, 6))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect()} == {(99, 0)}


def test_real_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    links = _links([(r.vec_id, list(r.embedding)) for r in df.collect()])
    got = {r.vec_id: r.n_links for r in vector_dedup.op3_near_vectors(spark, SF).collect()}
    assert got == {i: len(v) for i, v in links.items()}


def _recall(df, rows, mod, k, dim):
    whole = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == dim and None not in v and np.isfinite(v).all() and any(v)]
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % mod == 0, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    hit = total = 0
    for q, v in {i: v for i, v in whole if i % mod == 0}.items():
        want = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in whole if i != q)[:k]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1)) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)
        hit += len({i for _, i in want} & {i for _, _, i in mine})
        total += len(want)
        exact = dict((i, w) for i, w in whole)
        assert all(abs(s - np.linalg.norm(exact[i] - v)) < 1e-9 for _, s, i in mine)
    return hit / total


def test_nearest_recall(vectors, spark):
    df, rows = vectors
    assert _recall(df.where("size(embedding) = 8 or embedding is null"), rows, 100, 10, 8) >= 0.9
    real = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert _recall(real, [(r.vec_id, list(r.embedding)) for r in real.collect()], 10, 10, 64) >= 0.9


def test_nearest_are_the_same_for_any_partitioning(vectors, spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    df, rows = vectors
    real = spark.read.parquet(f"{SF}/embeddings.parquet")
    for d, mod in ((df, 50), (real, 10)):
        ways = [sorted(map(str, neighbours.search(d.repartition(n), F.col("vec_id") % mod == 0).collect())) for n in (1, 5, 16)]
        assert ways[0] == ways[1] == ways[2] and ways[0]
    # small blocks too go through the forest
    assert _recall(df.where("size(embedding) = 8 or embedding is null"), rows, 100, 10, 8) >= 0.9


def test_repeated_rows_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), *[(1, [0.9, 0.1])] * 30, (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0]), (100, [2.0]), (100, [2.0]), (100, [3.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, i, 1) for i in range(1, 6)] + [(100, 1, 4)]
    assert got[-1].score == 1.0


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (3, [2.0]), (5, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(0, 1, 3), (0, 2, 5)]
    none = df.where("false")
    assert neighbours.search(none, F.lit(True)).count() == 0 and vector_dedup.near_duplicates(none).count() == 0


def test_components_of_a_chain_a_star_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}
    a, b = components.forest(*np.array(pairs).T)
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {n: c for n, c in got.items() if n != c}


@pytest.mark.parametrize("exact", [1 << 14, 256])
def test_links_beside_a_hot_group(spark, monkeypatch, exact):
    monkeypatch.setattr(vector_dedup, "EXACT", exact)
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    hot = unit(unit(rng.standard_normal(64)) + 0.02 * rng.standard_normal((3000, 64)))
    own = rng.choice(3000, 40, replace=False)
    away = rng.standard_normal((40, 64))
    away = unit(away - (away * hot[own]).sum(1, keepdims=True) * hot[own])
    x = np.concatenate([hot, 0.952 * hot[own] + np.sqrt(1 - 0.952**2) * away, rng.standard_normal((500, 64))])
    x = unit(x)
    near = x @ x.T >= vector_dedup.LEAST
    links = near.sum(1) - 1
    assert links[3000:3040].min() >= 1 and links[3000:3040].max() < 3000 and not links[3040:].any()
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect()}
    assert got == {i: (n, 0 if n else i) for i, n in enumerate(links.tolist())}


def test_equal_vectors_are_one_class(spark):
    """A hot class costs one row after the first count: no later step sees its copies."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(20000)] + [(20000 + i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((60, 4)))]
    rows[7] = (7, [2.0, 4.0, 6.0, 8.0])  # the same direction, other bits
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    extra = {i: int((x[i] @ x[19999:].T >= vector_dedup.LEAST).sum()) for i in (0, 7)}
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) and all(got[i].n_links == 19999 + extra[0] - 1 and got[i].component_id == 0 for i in range(20000))


def test_the_second_round_grows_with_the_rows():
    agree = 1 - np.arccos(vector_dedup.LEAST) / np.pi
    for n in (1, 10**4, 10**5, 10**6, 10**8, 10**10):
        passes, bits = vector_dedup.second_round(n)
        assert (1 - agree**bits) ** passes <= vector_dedup.MISS and n / 2**bits <= vector_dedup.EXACT
