import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkplane import streaming
from inkplane.functions import boxes, geometry
from inkplane.operators import detections, graphs, labels, levels, profiles, search, tiles
from inkplane.sources import images, tables


@pytest.mark.parametrize(("tile", "overlap"), [(37, 0.2), (90, 0.0), (128, 0.55)])
def test_tiles_step_along_both_axes_to_the_edge(spark, tile, overlap):
    rnd = np.random.default_rng(tile)
    sizes = [(i, int(h), int(w)) for i, (h, w) in enumerate(rnd.integers(1, 5 * tile, (20, 2)))] + [(20, tile, tile + 1), (21, 1, 3 * tile)]
    sheets = spark.createDataFrame(sizes, "sheet_id int, h int, w int")
    step = tile - int(overlap * tile)
    got: dict = {}
    for r in tiles.grid(sheets, tile, overlap).collect():
        got.setdefault(r.sheet_id, []).append(r)
    for i, h, w in sizes:
        own = sorted(got[i], key=lambda r: r.tile_id)
        assert [r.tile_id for r in own] == list(range(len(own))) and own == sorted(own, key=lambda r: (r.y0, r.x0))
        for n, lo, hi in ((h, "y0", "y1"), (w, "x0", "x1")):
            spans = sorted({(r[lo], r[hi]) for r in own})
            starts = [a for a, _ in spans]
            assert starts[0] == 0 and spans[-1][1] == n and all(b - a == min(tile, n) for a, b in spans)
            gaps = np.diff(starts)
            assert (gaps[:-1] == step).all() and (gaps[-1:] <= step).all() and (gaps > 0).all()
        assert len(own) == len({r.x0 for r in own}) * len({r.y0 for r in own})
    with pytest.raises(ValueError):
        tiles.grid(sheets, 0)


def test_nms_against_a_loop(spark):
    rnd = np.random.default_rng(1)
    rows = [(int(i % 3), int(i), *map(float, (x, y, x + w, y + h)), float(round(c, 1))) for i, (x, y, w, h, c) in enumerate(np.column_stack([rnd.integers(0, 60, (90, 2)), rnd.integers(1, 30, (90, 2)), rnd.random(90)]))]
    d = spark.createDataFrame(rows, "sheet int, id int, x0 double, y0 double, x1 double, y1 double, conf double")
    kept = {}
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        def iou(a, b):
            w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            both = max(0, w) * max(0, h)
            return both / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - both)

        if all(iou(r, k) <= 0.3 for k in kept.get(r[0], [])):
            kept.setdefault(r[0], []).append(r)
    assert {(r.sheet, r.id) for r in detections.suppress(d).collect()} == {(s, r[1]) for s, k in kept.items() for r in k}


def test_readable_drops_signs_and_turned_duplicates(spark):
    poly = lambda x: [(x, 0.0), (x + 10, 0.0), (x + 10, 5.0), (x, 5.0)]
    rows = [(1, 1, "R 12", 0.9, poly(0.0)), (1, 2, "R 12", 0.5, poly(1.0)), (1, 3, "--", 0.99, poly(50.0)), (1, 4, "é", 0.4, poly(80.0))]
    d = spark.createDataFrame(rows, "sheet_id int, det_id int, text string, confidence double, poly array<struct<x:double,y:double>>")
    assert sorted(r.det_id for r in detections.readable(d).collect()) == [1, 4]


def test_directions_and_circles(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    l = F.lit  # noqa: E741
    assert value(geometry.are_coaxial(l(1.0), l(0.0), l(-1.0), l(0.0), 20.0)) and not value(geometry.are_coaxial(l(0.0), l(0.0), l(-1.0), l(0.0), 20.0))
    nan, inf = float("nan"), float("inf")
    assert not value(geometry.circles_match(l(nan), l(nan), l(inf), l(nan), l(nan), l(inf), 0.1))
    assert value(geometry.circles_match(l(0.0), l(0.0), l(10.0), l(0.5), l(0.0), l(10.5), 0.1))
    assert not value(geometry.is_arc(l(inf), l(0.0), l(5.0))) and value(geometry.is_arc(l(10.0), l(0.01), l(10.0)))
    assert value(boxes.iou(boxes.box(l(0), l(0), l(0), l(0)), boxes.box(l(0), l(0), l(0), l(0)))) == 0


def test_clip_is_that_of_the_kernel(spark):
    from inkplane.kernels import shapes

    rnd = np.random.default_rng(4)
    rows = [(i, [tuple(map(float, p)) for p in rnd.integers(-20, 80, (3, 2))]) for i in range(200)]
    d = spark.createDataFrame(rows, "id int, poly array<struct<x:double,y:double>>")
    got = {r.id: r.a for r in d.select("id", geometry.polygon_area(geometry.clip(F.col("poly"), F.lit(0), F.lit(0), F.lit(50), F.lit(40))).alias("a")).collect()}
    for i, p in rows:
        c = shapes.clip(np.array(p), (0, 0, 50, 40))
        assert (got[i] or 0) == pytest.approx(shapes.area(c) if c is not None else 0, abs=1e-6)


def test_level_cuts_agree_with_the_best_cut(spark):
    rows = [(p, i, t) for p, ts in enumerate([[5.0] * 40 + [12.0] * 40, [5.0] * 30, [3.0] * 20 + [9.0] * 40 + [3.0] * 20]) for i, t in enumerate(ts)]
    d = spark.createDataFrame(rows, "path long, ord int, t double")
    cuts = {}
    for r in profiles.level_cuts(d).collect():
        cuts.setdefault(r.path, set()).add(r.cut)
    assert cuts[0] == {40} and 1 not in cuts
    best = {r.path: r for r in profiles.explain_cut(d).collect()}
    assert best[0].cut == 40 and best[0].verdict == "cut" and best[1].verdict == "levels too close"


def test_peaks_know_their_prominence(spark):
    y = [0, 1, 3, 1, 2, 1, 5, 0.5, 1, 0]
    d = spark.createDataFrame([(i, float(i), float(v)) for i, v in enumerate(y)], "i int, at double, dens double")
    got = {r.i: r.prominence for r in levels.peaks(d).collect()}
    assert got == {2: 2.0, 4: 1.0, 6: 5.0, 8: 0.5}


def test_components_chains_and_matching(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 7), (7, 5), (9, 9)], "a long, b long")
    assert {r.node: r.component for r in graphs.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 9: 9}
    got = {r.node: (r.chain, r.step) for r in graphs.chains(e.where("a < 9")).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 5: (5, 0), 6: (5, 1), 7: (5, 2)}
    p = spark.createDataFrame([(0, 1, 2, 5.0), (0, 2, 3, 1.0), (0, 3, 4, 2.0), (0, 1, 4, 9.0)], "node int, a int, b int, score double")
    assert {(r.a, r.b) for r in graphs.match_greedy(p).collect()} == {(2, 3), (1, 4)}


def test_validation_split_is_the_nearest(spark):
    d = spark.createDataFrame([("aa", 4), ("bb", 3), ("cc", 2), ("dd", 1)], "name string, n long")
    r = labels.choose_validation(d, 0.2).first()
    assert r.n == 2 and r.names == ["cc"]
    with pytest.raises(ValueError):
        labels.choose_validation(d.where("name = 'aa'"))


def test_validation_split_of_many_sheets_is_drawn(spark):
    rows = [(f"s{i:03}", 1 + i % 7) for i in range(60)]
    d = spark.createDataFrame(rows, "name string, n long")
    total = sum(n for _, n in rows)
    got = [labels.choose_validation(d, 0.2, seed).first() for seed in (0, 0, 1)]
    assert got[0] == got[1] and 0 < len(got[0].names) < 60
    for r in got:
        assert r.n == sum(n for s, n in rows if s in r.names) and abs(r.n - 0.2 * total) <= 2


def test_search_strategies(spark):
    rnd = np.random.default_rng(0)
    v = rnd.standard_normal((12, 5))
    rows = [(f"s{i % 3}", i // 3, [float(x) for x in v[i]]) for i in range(12)]
    d = spark.createDataFrame(rows, "name string, view_no int, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for name in ("best_pair", "mean_pair", "mean_embedding"):
        got = {r["name"]: r.score for r in search.STRATEGIES[name](d, "s0").collect()}
        for k in range(3):
            s = u[0::3] @ u[k::3].T
            q, c = v[0::3].mean(0), v[k::3].mean(0)
            want = {"best_pair": s.max(), "mean_pair": s.mean(), "mean_embedding": q @ c / np.linalg.norm(q) / np.linalg.norm(c)}[name]
            assert got[f"s{k}"] == pytest.approx(want)
    assert search.similar(d, "s1", top_k=2).first()["name"] == "s1"


def test_best_pair_of_a_query_beyond_the_bound(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    rows = [(f"s{i % 3}", i // 3, [float(x) for x in v]) for i, v in enumerate(rnd.standard_normal((60, 5)))]
    rows += [("s0", 100 + i, rows[0][2]) for i in range(20)]
    d = spark.createDataFrame(rows, "name string, view_no int, vec array<double>")
    want = {r["name"]: r.score for r in search.best_pair(d, "s0").collect()}
    monkeypatch.setattr(search, "MOST_VIEWS", 7)
    assert {r["name"]: r.score for r in search.best_pair(d, "s0").collect()} == want and len(want) == 3
    assert [r["name"] for r in search.similar(d, "s0", top_k=2).collect()] == [n for n, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:2]]


def test_embeddings_round_trip(spark, tmp_path):
    sheets = spark.createDataFrame([("a", [b"1", b"22"], None), ("b", [], None), ("c", [b"3"], "broken")], "name string, crops array<binary>, error string")
    d = search.embed(sheets, lambda: lambda crop: [float(len(crop)), 1.0], 2)
    assert {(r["name"], r.view_no, tuple(r.vec)) for r in d.collect()} == {("a", 0, (1.0, 1.0)), ("a", 1, (2.0, 1.0))}
    tables.save_embeddings(d, str(tmp_path / "e"))
    assert tables.load_embeddings(spark, str(tmp_path / "e")).count() == 2
    with pytest.raises(ValueError):
        tables.save_embeddings(d.unionByName(d), str(tmp_path / "f"))
    tables.save_embeddings(d.limit(1), str(tmp_path / "e"))
    assert tables.load_embeddings(spark, str(tmp_path / "e")).count() == 1
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        tables.save_embeddings(d, str(tmp_path / "e"), overwrite=False)


def test_labels_from_files(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "classes.txt").write_text("arrow\n\n  box \n")
    (tmp_path / "l" / "x.txt").write_text("0 0 0 1 0 1 1\n\n1 0.5 0.5 0.6 0.5 0.6 0.7\n")
    (tmp_path / "l" / "y.txt").write_text("0 0 0 1 0\n7 0 0 1 0 1 1\n0 0 0 2 0 1 1\nq 1\n0 0 0 1 0 1 1 1\n")
    assert [r["name"] for r in tables.read_classes(spark, str(tmp_path / "classes.txt")).orderBy("number").collect()] == ["arrow", "box"]
    got = tables.read_labels(spark, str(tmp_path / "l"), 2).orderBy("name", "no").collect()
    assert [(r["name"], r.no, r.error) for r in got] == [("x", 1, None), ("x", 3, None), ("y", 1, "less than three points"), ("y", 2, "class out of range"), ("y", 3, "coordinate out of range"), ("y", 4, "class is not a number"), ("y", 5, "odd number of coordinates")]
    with pytest.raises(Exception, match="y:"):
        tables.strict(tables.read_labels(spark, str(tmp_path / "l"), 2)).collect()
    sheets = spark.createDataFrame([("x",), ("z",)], "name string")
    assert {r["name"]: r.error for r in tables.with_labels(sheets, tables.read_labels(spark, str(tmp_path / "l"), 2)).collect()} == {"x": None, "z": "no labels: z"}


@pytest.fixture
def export(tmp_path):
    """Six sheets with two classes; d has no objects but a label file."""
    rnd = np.random.default_rng(1)
    src = tmp_path / "src"
    (src / "labels").mkdir(parents=True)
    (src / "classes.txt").write_text("arrow\nbox\n")
    objects = {"a-1": [(0, 0.1, 0.1, 0.05), (1, 0.5, 0.5, 0.1)], "a-2": [(0, 0.9, 0.9, 0.08), (1, 0.2, 0.7, 0.02)], "b-3": [(1, 0.3, 0.3, 0.1), (0, 0.31, 0.62, 0.1)], "c": [(0, 0.4, 0.4, 0.3), (1, 0.7, 0.1, 0.05)], "d": []}
    for name, own in objects.items():
        images.save(str(src / "images" / f"{name}.png"), rnd.integers(0, 255, (150, 200, 3), dtype=np.uint8))
        (src / "labels" / f"{name}.txt").write_text("".join(f"{c} {x} {y} {x + s} {y} {x + s} {y + s}\n" for c, x, y, s in own))
    images.save(str(src / "images" / "._a-1.png"), np.zeros((2, 2, 3), np.uint8))
    return src, objects


def test_data_set_of_tiles(spark, export, tmp_path):
    import json

    from inkplane.kernels import shapes

    src, objects = export
    dst = tmp_path / "out"
    about = tables.make_dataset(spark, str(src), str(dst), tile=64, overlap=0.25, min_area=0.5, bg_ratio=0.25, val=["3"])
    assert about["val"] == ["b-3"] and about["train"] == ["a-1", "a-2", "c", "d"] and about["objects"]["d"] == 0 and about["manual_val"]
    assert json.loads((dst / "split.json").read_text()) == about
    assert (dst / "data.yaml").read_text() == 'train: images/train\nval: images/val\nnames:\n  0: "arrow"\n  1: "box"\n'
    starts = lambda n: sorted({min(k, n - 64) for k in range(0, n - 16, 48)})
    want, empty = {}, {"train": set(), "val": set()}
    for name, own in objects.items():
        part = "val" if name == "b-3" else "train"
        for y0 in starts(150):
            for x0 in starts(200):
                lines, partly = [], False
                for c, x, y, s in own:
                    p = np.array([(x, y), (x + s, y), (x + s, y + s)]) * (200, 150)
                    cut = shapes.clip(p, (x0, y0, x0 + 64, y0 + 64))
                    share = shapes.area(cut) / shapes.area(p) if cut is not None else 0
                    if share >= 0.5:
                        lines.append((c, shapes.area((cut - (x0, y0)) / 64)))
                    partly |= 0 < share < 0.5
                if lines:
                    want[part, f"{name}_{x0}_{y0}"] = lines
                elif not partly:
                    empty[part].add(f"{name}_{x0}_{y0}")
    files = {(p, f.stem): f for p in ("train", "val") for f in (dst / "labels" / p).iterdir()}
    assert set(files) == {(p, f.stem) for p in ("train", "val") for f in (dst / "images" / p).iterdir()}
    assert about["images"] == {p: sum(q == p for q, _ in files) for p in ("train", "val")}
    found = {k: f.read_text().splitlines() for k, f in files.items()}
    assert {k for k, v in found.items() if v} == set(want)
    background = {p: {n for (q, n), v in found.items() if q == p and not v} for p in ("train", "val")}
    assert background["val"] == empty["val"] and background["train"] <= empty["train"]
    assert len(background["train"]) == min(len(empty["train"]), round(0.25 * sum(p == "train" for p, _ in want)))
    for key, lines in want.items():
        got = [(int(t[0]), shapes.area(np.array(t[1:], float).reshape(-1, 2))) for t in map(str.split, found[key])]
        assert [c for c, _ in got] == [c for c, _ in lines] and np.allclose([a for _, a in got], [a for _, a in lines], atol=1e-4)
    name, x0, y0 = (int(v) if k else v for k, v in enumerate(min(n for p, n in want if p == "train").rsplit("_", 2)))
    whole = images.load(str(src / "images" / f"{name}.png"))
    assert (images.load(str(dst / "images" / "train" / f"{name}_{x0}_{y0}.png")) == whole[y0 : y0 + 64, x0 : x0 + 64]).all()


def test_data_set_of_whole_sheets_and_its_errors(spark, export, tmp_path):
    src, objects = export
    dst = tmp_path / "out"
    about = tables.make_dataset(spark, str(src), str(dst), tile=None)
    assert sorted(about["train"] + about["val"]) == sorted(objects) and sum(about["images"].values()) == 5
    for part in ("train", "val"):
        assert sorted(f.stem for f in (dst / "images" / part).iterdir()) == about[part] == sorted(f.stem for f in (dst / "labels" / part).iterdir())
    (dst / "own.txt").write_text("stays")
    with pytest.raises(ValueError, match="not empty"):
        tables.make_dataset(spark, str(src), str(dst), tile=None)
    tables.make_dataset(spark, str(src), str(dst), tile=64, val=["a-2"], overwrite=True)
    assert (dst / "own.txt").exists() and all("_" in f.stem for f in (dst / "images" / "train").iterdir())
    for how, match in ((dict(val=["9"]), "names 0"), (dict(val=["d"]), "lacks"), (dict(overlap=1.0), "range"), (dict(tile=0), "range")):
        with pytest.raises(ValueError, match=match):
            tables.make_dataset(spark, str(src), str(tmp_path / "new"), **how)
    (src / "labels" / "c.txt").unlink()
    with pytest.raises(FileNotFoundError, match="c"):
        tables.make_dataset(spark, str(src), str(tmp_path / "new"))


def test_components_of_long_chains_and_stars(spark):
    import random

    rnd = random.Random(3)
    n = 3000
    names = list(range(n))
    rnd.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(n - 1) if i % 500 != 499] + [(10**6, 10**6 + i) for i in range(1, 800)] + [(7 * 10**6, 7 * 10**6)]
    d = spark.createDataFrame(edges, "a int, b int").repartition(7)
    got = {r.node: r.component for r in graphs.connected_components(d).collect()}
    for k in range(0, n, 500):
        own = names[k : k + 500]
        assert {got[i] for i in own} == {min(own)}
    assert {got[10**6 + i] for i in range(800)} == {10**6} and got[7 * 10**6] == 7 * 10**6
    assert dict(graphs.connected_components(d).dtypes) == {"node": "int", "component": "int"}


def test_sheets_from_files_keep_order_and_isolate_errors(spark, tmp_path):
    from inkplane import cli

    img = np.full((120, 160, 3), 255, np.uint8)
    img[20:26, 20:140] = img[94:100, 20:140] = 0
    img[20:100, 20:26] = img[20:100, 134:140] = 0
    img[60, 5:60] = 0  # no view without a thin line
    for n in ("b.png", "a.PNG"):
        images.save(str(tmp_path / "in" / n), img)
    (tmp_path / "in" / "c.png").write_bytes(b"broken")
    (tmp_path / "in" / "d.txt").write_text("no picture")
    found = images.discover(spark, [str(tmp_path / "in")])
    got = detections.ordered(images.map_sheets(found, lambda path, x, more: {"h": x.shape[0]}, "h int")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.h, r.error is None) for r in got] == [("a.PNG", 120, True), ("b.png", 120, True), ("c.png", None, False)]
    assert cli.main(["clean", str(tmp_path / "in"), "--out", str(tmp_path / "out")]) == 1
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.png", "b.png"]
    assert (images.load(str(tmp_path / "out" / "a.png")).min(2)[22, 30:130] == 0).all()
    assert cli.main(["views", str(tmp_path / "in" / "b.png"), "--out", str(tmp_path / "v"), "--size", "64"]) == 0
    assert images.load(str(tmp_path / "v" / "b_0.png")).shape == (64, 64, 3)


def test_detections_stream_through_the_batch_plan(spark, tmp_path):
    rows = [(1, i, 0, 0.0, 0.0, 1.0, 1.0, i / 10) for i in range(10)]
    spark.createDataFrame(rows, streaming.DETECTIONS).repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        streaming.keep_sure(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), spark).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(3, 10))


def test_circle_fit_of_points(spark):
    a = [math.radians(x) for x in range(0, 90, 5)]
    rows = [(0, 3 + 10 * math.cos(t), 4 + 10 * math.sin(t)) for t in a] + [(1, float(i), float(i)) for i in range(9)]
    got = {r.path: r for r in profiles.fit_circle(spark.createDataFrame(rows, "path int, x double, y double")).collect()}
    assert got[0].r == pytest.approx(10) and got[0].cx == pytest.approx(3) and got[1].r == float("inf")
