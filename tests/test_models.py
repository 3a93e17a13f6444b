import random

import numpy as np
import pytest

from inkplane.operators import models, tiles
from inkplane.sources import images

SIDE = 64


def _dots(points, shape=(150, 200), side=8):
    img = np.full((*shape, 3), 255, np.uint8)
    for x, y in points:
        img[y : y + side, x : x + side] = 0
    return img


def _finder():
    """A detector of black squares of 8 pixels that lie wholly in its picture, away from grey and edges; masks are all positive."""

    def run(blob):
        dark = blob[0].max(0) < 0.1
        found = []
        for y in range(SIDE - 7):
            for x in range(SIDE - 7):
                around = dark[max(0, y - 1) : y + 9, max(0, x - 1) : x + 9]
                if dark[y : y + 8, x : x + 8].all() and around.sum() == 64:
                    found.append((x, y, x + 8, y + 8, 0.9, 0, 1.0))
        out = np.zeros((1, 300, 7), np.float32)
        out[0, : len(found)] = np.array(found, np.float32).reshape(-1, 7)
        return out, np.ones((1, 1, 16, 16), np.float32)

    return run


def _broken():
    raise RuntimeError("no such model")


def _sheets(spark, pictures):
    return spark.createDataFrame([(n, 0, images.encode_png(p) if isinstance(p, np.ndarray) else p) for n, p in pictures.items()], "path string, source int, content binary")


def test_every_object_counts_once_wherever_tiles_meet(spark):
    rnd = random.Random(1)
    pictures, want = {}, {}
    for k in range(6):
        h, w = rnd.randrange(40, 260), rnd.randrange(40, 260)
        places = []
        for _ in range(12):
            x, y = rnd.randrange(w - 8), rnd.randrange(h - 8)
            if all(abs(x - a) > 9 or abs(y - b) > 9 for a, b in places):
                places.append((x, y))
        pictures[f"s{k}"], want[f"s{k}"] = _dots(places, (h, w)), sorted(places)
    sheets = _sheets(spark, pictures | {"broken": b"x"})
    # squares up to half an overlap are seen whole by the tile in whose zone they lie
    got = {r.sheet: r for r in models.arrows(sheets, _finder, SIDE, 0.5, 0.4, spread=3).collect()}
    assert set(got) == set(want)
    for name, places in want.items():
        assert sorted((int(b.x0), int(b.y0)) for b in got[name].boxes) == places
        mask = models.painted([s.asDict() for s in got[name].strips], *pictures[name].shape[:2])
        assert ((mask > 0) == (pictures[name][..., 0] == 0)).all()
    assert models.arrows(sheets, _finder, SIDE, 0.95, 0.4).count() == 0


def test_an_error_of_a_model_is_its_sheets(spark):
    sheets = _sheets(spark, {"a": _dots([(10, 10)])})
    found, read = models.arrows(sheets, _broken, SIDE), models.texts(sheets, _broken)
    row = models.with_models(sheets, found, read).first()
    assert "no such model" in row.model_error and row.strips is None and row.texts is None
    assert models.with_models(sheets).first().model_error is None


def test_zones_part_sheets_of_any_size(spark):
    rnd = random.Random(2)
    shapes = [(i, rnd.randrange(1, 900), rnd.randrange(1, 900)) for i in range(25)]
    sheets = spark.createDataFrame(shapes, "sheet_id int, h int, w int")
    zones: dict = {}
    for r in tiles.zones(tiles.grid(sheets, 96, 0.3), sheets).collect():
        zones.setdefault(r.sheet_id, []).append(r)
    for i, h, w in shapes:
        for _ in range(60):
            x, y = rnd.uniform(0, w), rnd.uniform(0, h)
            own = [r for r in zones[i] if r.zx0 <= x < r.zx1 and r.zy0 <= y < r.zy1]
            assert len(own) == 1 and own[0].x0 <= x <= own[0].x1 and own[0].y0 <= y <= own[0].y1


def test_masks_are_the_prototypes_within_the_box():
    rng = np.random.default_rng(3)
    for _ in range(30):
        proto, coef = rng.normal(size=(5, 16, 16)), rng.normal(size=5)
        x0, y0 = rng.uniform(-5, 50, 2)
        box = np.array([x0, y0, x0 + rng.uniform(0, 30), y0 + rng.uniform(0, 30)])
        low = np.tensordot(coef, proto, 1)
        want = np.zeros((50, 60), bool)
        for y in range(50):
            for x in range(60):
                if box[0] <= x < box[2] and box[1] <= y < box[3]:
                    v, u = np.clip((y + 0.5) / 4 - 0.5, 0, 15), np.clip((x + 0.5) / 4 - 0.5, 0, 15)
                    i, j = int(v), int(u)
                    i2, j2 = min(i + 1, 15), min(j + 1, 15)
                    top = low[i, j] * (1 - u + j) + low[i, j2] * (u - j)
                    low_ = low[i2, j] * (1 - u + j) + low[i2, j2] * (u - j)
                    want[y, x] = top * (1 - v + i) + low_ * (v - i) > 0
        strips = models.mask_strips(coef, proto, box, SIDE, 50, 60)
        got = models.painted([{"y": y, "x0": a, "x1": b} for y, a, b in strips], 50, 60) > 0
        assert (got == want).all()


def _corner_reader():
    def read(picture):
        h, w = picture.shape[:2]
        return [("A1", 0.9, [(0, 0), (w, 0), (w, h), (0, h)]), ("dim", 0.1, [(0, 0), (1, 0), (1, 1)]), ("--", 0.9, [(0, 0), (1, 0), (1, 1)])]

    return read


def test_texts_of_all_turns_come_back_once(spark):
    sheets = _sheets(spark, {"a": _dots([(10, 10)], (60, 100)), "b": _dots([(10, 10)], (31, 40))})
    rows = models.read_turned(sheets, _corner_reader, (0, 90, 270)).collect()
    assert sorted({r.angle for r in rows}) == [0, 90, 270] and len(rows) == 18
    got = {r.sheet: r.texts for r in models.texts(sheets, _corner_reader).collect()}
    for name, (w, h) in {"a": (100, 60), "b": (40, 31)}.items():
        assert [t.text for t in got[name]] == ["A1"]  # the turns give one box; unsure ones and those without a letter go
        xs, ys = [p.x for p in got[name][0].poly], [p.y for p in got[name][0].poly]
        assert np.allclose([min(xs), min(ys), max(xs), max(ys)], [0, 0, w, h], atol=1)


def test_plots():
    ink = np.zeros((5, 5), np.uint8)
    ink[2] = 255
    p = models.plot_classes(ink, [np.array([[2, 0], [2, 1]]), np.array([[2, 3]])], np.array([True, False]))
    assert p[2, 0].tolist() == [255, 0, 0] and p[2, 3].tolist() == [0, 255, 255] and p[2, 2].tolist() == [200] * 3
    assert models.overlay(np.full((2, 2, 3), 255, np.uint8), np.eye(2, dtype=np.uint8))[0, 0].tolist() == [255, 127, 127]
    assert models.overlay(np.full((2, 2), 255, np.uint8), np.eye(2, dtype=np.uint8))[0, 1].tolist() == [255] * 3


def test_formats(spark, tmp_path):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (23, 31, 3), dtype=np.uint8)
    assert (images.decode(images.encode_bmp(img)) == img).all() and images.size_of(images.encode_bmp(img)) == (23, 31) == images.size_of(images.encode_png(img))
    with pytest.raises(ValueError):
        images.save(str(tmp_path / "x.gif"), img)
    # the JVM's own encoders write what the sources must read
    io, jvm = spark._jvm.javax.imageio.ImageIO, spark._jvm
    smooth = np.full((20, 30, 3), 200, np.uint8)
    smooth[5:15, 5:25] = 40
    buffered = io.read(jvm.java.io.ByteArrayInputStream(bytearray(images.encode_png(smooth))))
    for ending in ("jpg", "tif", "bmp"):
        (tmp_path / "in").mkdir(exist_ok=True)
        assert io.write(buffered, ending, jvm.java.io.File(str(tmp_path / "in" / f"{ending}.{ending}")))
    (tmp_path / "in" / "broken.jpeg").write_bytes(b"\xff\xd8\xff\xe0 nothing")
    images.save(str(tmp_path / "in" / "own.png"), smooth)
    got = images.map_sheets(images.discover(spark, [str(tmp_path / "in")]), lambda path, x, more: {"sum": float(np.abs(x.astype(int) - smooth).max())}, "sum double").collect()
    by = {images.stem(r.path): r for r in got}
    assert set(by) == {"jpg", "tif", "bmp", "broken", "own"} and by["broken"].error
    assert by["own"].sum == by["tif"].sum == by["bmp"].sum == 0 and by["jpg"].sum < 60


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_filters_are_undone(channels):
    """All five filters, applied here a byte at a time."""
    import struct
    import zlib

    rng = np.random.default_rng(channels)
    h, w = 11, 9
    img = rng.integers(0, 256, (h, w * channels), dtype=np.uint8).astype(int)
    rows, n = b"", channels
    for y in range(h):
        kind = y % 5
        line = []
        for i in range(w * n):
            a, b, c = (img[y, i - n] if i >= n else 0), (img[y - 1, i] if y else 0), (img[y - 1, i - n] if y and i >= n else 0)
            paeth = min((a, b, c), key=lambda v: abs(a + b - c - v))
            line.append((img[y, i] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        rows += bytes([kind, *line])

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + b"\0" * 4

    data = images._SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    got = images.decode(data)
    want = img.reshape(h, w, n)
    assert (got == (np.repeat(want, 3, axis=2) if n == 1 else want[..., :3])).all()
