import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hn

from inkplane.kernels import lines, raster, shapes
from inkplane.operators import sheets
from inkplane.sources import images

masks = hn.arrays(np.uint8, hn.array_shapes(min_dims=2, max_dims=2, min_side=1, max_side=14), elements=st.sampled_from([0, 255]))


def _flood(on, diagonal):
    lab, n = np.zeros(on.shape, int), 0
    for y, x in zip(*np.nonzero(on), strict=True):
        if lab[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        lab[y, x] = n
        while todo:
            a, b = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    c, d = a + dy, b + dx
                    if (diagonal or not (dy and dx)) and 0 <= c < on.shape[0] and 0 <= d < on.shape[1] and on[c, d] and not lab[c, d]:
                        lab[c, d] = n
                        todo.append((c, d))
    return n, lab


@settings(max_examples=60, deadline=None)
@given(masks, st.booleans())
def test_components_are_those_of_a_flood(mask, diagonal):
    n, lab = raster.label(mask, diagonal)
    m, want = _flood(mask > 0, diagonal)
    assert n == m and (lab == want).all()


@settings(max_examples=60, deadline=None)
@given(masks)
def test_distance_is_that_of_all_pairs(mask):
    d = raster.distance(mask)
    bg = np.argwhere(mask == 0)
    for y, x in np.argwhere(mask > 0):
        want = np.sqrt(((bg - [y, x]) ** 2).sum(1).min()) if len(bg) else np.inf
        assert d[y, x] == pytest.approx(want)
    assert (d[mask == 0] == 0).all()


@settings(max_examples=40, deadline=None)
@given(masks)
def test_thinning_keeps_components_and_input(mask):
    before = mask.copy()
    inner = np.zeros_like(mask)
    inner[1:-1, 1:-1] = mask[1:-1, 1:-1]
    t = raster.thin(inner)
    assert (mask == before).all() and not (t > inner).any()
    assert raster.label(t)[0] <= raster.label(inner)[0] and (raster.thin(t) == t).all()


@settings(max_examples=60, deadline=None)
@given(masks, st.integers(1, 4))
def test_dilation_is_a_disc_around_each_pixel(mask, r):
    out = raster.dilate(mask, r)
    yy, xx = np.mgrid[: mask.shape[0], : mask.shape[1]]
    want = np.zeros(mask.shape, bool)
    for y, x in np.argwhere(mask > 0):
        want |= (yy - y) ** 2 + (xx - x) ** 2 <= r * r
    assert ((out > 0) == want).all()


@settings(max_examples=60, deadline=None)
@given(hn.arrays(np.uint8, st.tuples(st.integers(1, 9), st.integers(1, 9), st.just(3))))
def test_png_round_trip(img):
    assert (images.decode_png(images.encode_png(img)) == img).all()
    assert (images.decode_png(images.encode_png(img[..., 0]))[..., 1] == img[..., 0]).all()


def test_png_errors():
    with pytest.raises(ValueError):
        images.load(b"nothing")
    with pytest.raises(FileNotFoundError):
        images.load("/nowhere/x.png")
    with pytest.raises(TypeError):
        images.encode_png(np.zeros((2, 2), float))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=12))
def test_hull_and_rectangle_hold_all_points(points):
    h = shapes.hull(np.array(points))
    if len(h) > 2:
        assert shapes.is_convex(h) and all(shapes.contains(h, *p) for p in points)
        r = shapes.min_area_rect(np.array(points))
        assert shapes.area(r) >= shapes.area(h) - 1e-6
        u, v = r[1] - r[0], r[3] - r[0]
        assert abs(u @ v) < 1e-6


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(-10, 30), st.integers(-10, 30)), min_size=3, max_size=3))
def test_clip_of_triangles(points):
    p = np.array(points, float)
    c = shapes.clip(p, (0, 0, 20, 20))
    if c is not None:
        assert c.min() >= 0 and c.max() <= 20 and shapes.area(c) <= shapes.area(p) + 1e-6
    inside = (p >= 0).all() and (p <= 20).all()
    if inside and shapes.area(p) > 0:
        assert shapes.area(c) == pytest.approx(shapes.area(p))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 18), st.integers(-3, 18)), min_size=3, max_size=9))
def test_convex_polygons_hold_the_pixels_on_one_side_of_all_edges(points):
    h = shapes.hull(np.array(points))
    if len(h) > 2:
        got = shapes.fill_convex((15, 16), h) > 0
        want = np.array([[shapes.contains(h, x, y) for x in range(16)] for y in range(15)])
        assert (got == want).all()


def test_clip_against_counted_pixels():
    rnd = np.random.default_rng(0)
    for _ in range(30):
        p = rnd.uniform(-20, 60, (3, 2))
        got = shapes.clip(p, (0, 0, 40, 40))
        fine = shapes.fill_convex((400, 400), p * 10 - 0.5)
        assert (shapes.area(got) if got is not None else 0) == pytest.approx((fine > 0).sum() / 100, abs=5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-2, 22), st.integers(-2, 22)), min_size=1, max_size=6), st.integers(1, 7), st.booleans())
def test_lines_are_painted_within_half_their_width(points, width, steps):
    p = np.array(points, float)
    if steps:  # neighbouring pixels only
        p = np.cumsum(np.sign(p - 8), axis=0) + 8
    got = shapes.draw_line(np.zeros((20, 20), np.uint8), p, width) > 0
    yy, xx = np.mgrid[:20, :20]
    near = np.full((20, 20), np.inf)
    for a, b in zip(p[:-1], p[1:], strict=True) if len(p) > 1 else [(p[0], p[0])]:
        d = b - a
        t = np.clip(((xx - a[0]) * d[0] + (yy - a[1]) * d[1]) / max(d @ d, 1e-12), 0, 1)
        near = np.minimum(near, np.hypot(xx - a[0] - t * d[0], yy - a[1] - t * d[1]))
    edge = np.abs(near - width / 2) < 1e-9
    assert (got == (near <= width / 2))[~edge].all()


def _zhang_suen(mask):
    on = {(y, x) for y, x in np.argwhere(mask)}
    h, w = mask.shape
    while True:
        before = len(on)
        for a, b in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            gone = set()
            for y, x in on:
                if 0 < y < h - 1 and 0 < x < w - 1:
                    p = [(y + dy, x + dx) in on for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
                    turns = sum(not p[i] and p[(i + 1) % 8] for i in range(8))
                    if 2 <= sum(p) <= 6 and turns == 1 and not all(p[i] for i in a) and not all(p[i] for i in b):
                        gone.add((y, x))
            on -= gone
        if len(on) == before:
            return on


@settings(max_examples=60, deadline=None)
@given(masks)
def test_thinning_is_zhang_suen(mask):
    assert {tuple(p) for p in np.argwhere(raster.thin(mask))} == _zhang_suen(mask)


def _walked(on):
    """Branches by following pixels one at a time."""
    near = {p: [q for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (q := (p[0] + dy, p[1] + dx)) in on and not (dy and dx and ((p[0] + dy, p[1]) in on or (p[0], p[1] + dx) in on))] for p in on}
    out, seen = set(), set()
    for p in near:
        if len(near[p]) != 2:
            for q in near[p]:
                way = [p, q]
                while len(near[way[-1]]) == 2:
                    a, b = near[way[-1]]
                    way.append(b if a == way[-2] else a)
                seen |= set(way)
                out.add(min(tuple(way), tuple(way[::-1])))
    rings = {p for p in near if len(near[p]) == 2} - seen
    return out, rings


@settings(max_examples=80, deadline=None)
@given(masks)
def test_branches_are_those_of_a_walk(mask):
    on = {tuple(p) for p in np.argwhere(mask).tolist()}
    want, rings = _walked(on)
    got, degree = lines.branches(mask)
    got = [tuple(map(tuple, p.tolist())) for p in got]
    round_ = [p for p in got if p[0] == p[-1] and degree.get(p[0], 2) == 2]
    assert {p for r in round_ for p in r} == rings and sum(len(r) - 1 for r in round_) == len(rings)
    rest = [min(p, p[::-1]) for p in got if p not in round_]
    assert set(rest) == want and len(rest) == len(want)


def test_simplify_border_circle():
    line = np.column_stack([np.arange(50), np.r_[np.zeros(25), np.arange(25)]])
    assert len(shapes.simplify(line, 0.5)) == 3
    yy, xx = np.mgrid[:60, :60]
    disc = np.where((yy - 30) ** 2 + (xx - 30) ** 2 <= 400, 255, 0).astype(np.uint8)
    ring = shapes.border(disc)
    assert shapes.area(ring) == pytest.approx(np.pi * 400, rel=0.06)
    c, r, err = shapes.fit_circle(ring)
    assert np.allclose(c, 30, atol=0.5) and r == pytest.approx(20, abs=0.6) and err < 0.03
    c, r, err = shapes.fit_circle(np.column_stack([np.arange(40), np.arange(40) * 0.5]))
    assert np.isnan(c).all() and r == np.inf and err == 0
    a = np.radians(np.linspace(0, 60, 80))
    assert shapes.fit_circle(np.column_stack([80 * np.cos(a), 80 * np.sin(a)]))[1] == pytest.approx(80, rel=0.01)


def _sheet(t=6, thin=1):
    img = np.full((300, 400, 3), 255, np.uint8)
    for x0, y0, x1, y1 in ((50, 50, 350, 50 + t), (50, 250 - t, 350, 250), (50, 50, 50 + t, 250), (350 - t, 50, 350, 250)):
        img[y0:y1, x0:x1] = 0
    img[20 : 20 + thin, 60:200] = 0
    img[150 : 150 + thin, 100:300] = 0
    img[200 : 200 + thin, 30:120] = 0
    return img


@pytest.mark.parametrize("t", [4, 6, 10])
def test_thickness_of_a_drawn_contour(t):
    assert raster.thickness(raster.binarize(raster.gray(_sheet(t)))) == pytest.approx(t, abs=1.1)


def test_preprocess_brings_the_contour_to_the_target():
    _, g, b, scale, t = raster.preprocess(_sheet(10), 6.0)
    assert scale == pytest.approx(6 / t) and g.shape == b.shape and g.shape[0] == round(300 * scale)
    assert raster.preprocess(_sheet(6), None)[3:] == (1.0, None)
    with pytest.raises(ValueError):
        raster.preprocess(_sheet(), -1)
    with pytest.raises(TypeError):
        raster.preprocess(np.zeros((3, 3)))
    with pytest.raises(ValueError):
        raster.thickness(np.zeros((9, 9), np.uint8))


def test_gray_takes_the_darkest_channel():
    img = np.array([[[0, 0, 0], [0, 0, 255], [255, 165, 0], [255, 255, 255]]], np.uint8)
    assert raster.gray(img).tolist() == [[0, 0, 0, 255]]


def test_clean_keeps_the_contour_and_drops_thin_lines():
    img = _sheet(8, 1)
    out = sheets.clean(img)
    assert out["mask"][54, 100] and not out["mask"][20, 100] and not out["mask"][150, 200]
    assert ((out["mask"] > 0) <= (img.min(2) < 255)).mean() > 0.98
    assert len(out["boxes"]) == 1 and all(abs(a - b) <= 5 for a, b in zip(out["boxes"][0], (26, 26, 374, 274), strict=True))  # three thicknesses around it
    crop = sheets.crops([v["picture"] for v in out["views"]], 64)[0]
    assert crop.shape == (64, 64, 3) and [r.shape for r in sheets.rotations(crop)] == [(64, 64, 3)] * 4 and sheets.crops([], 64) == []


def test_text_is_cleared_and_lines_stay():
    b = np.zeros((80, 120), np.uint8)
    b[10:20, 10:14] = b[10:20, 20:24] = 255
    b[50:56, 5:115] = 255
    poly = np.array([[8, 8], [26, 8], [26, 22], [8, 22]])
    out = sheets.clear_text(b, [poly])
    assert not out[:30].any() and (out[50:56, 5:115] > 0).all()


def test_rotation_grows_the_canvas():
    img = _sheet()
    turned, mat = raster.rotate(img, 90)
    assert turned.shape == (400, 300, 3) and raster.rotate(img, 0)[0] is img
    big, mat = raster.rotate(img, 30)
    p = raster.invert(mat) @ np.append(mat @ [50, 60, 1], 1)
    assert np.allclose(p, [50, 60]) and big.shape[0] > 300
    with pytest.raises(ValueError):
        raster.rotate(img, 360)


def test_resize_and_scale_mask():
    img = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert (raster.resize(img, 4, 4) == np.rint(img.reshape(4, 2, 4, 2).mean((1, 3)))).all()
    assert raster.resize(img, 16, 16).shape == (16, 16) and (raster.resize(img, 8, 8) == img).all()
    m = raster.scale_mask(img, (20, 20), 0.4)
    assert m.shape == (20, 20) and m[-1, -1] == img[7, 7]
    assert raster.blob(np.zeros((5, 6, 3), np.uint8), 8).shape == (1, 3, 8, 8)


def _graph(mask, **how):
    return lines.build(mask, raster.distance(mask), **how)


def test_a_bar_is_one_path_and_a_cross_is_two():
    m = np.zeros((120, 160), np.uint8)
    m[60:66, 10:150] = 255
    g = _graph(m)
    assert len(g.paths) == 1 and 120 < g.length(0) < 150 and np.median(g.thickness(0)) == pytest.approx(6, abs=1)
    m[10:110, 80:86] = 255
    assert len(_graph(m).paths) == 2


def test_a_ring_closes():
    yy, xx = np.mgrid[:100, :100]
    r = np.hypot(yy - 50, xx - 50)
    g = _graph(np.where(np.abs(r - 30) <= 3, 255, 0).astype(np.uint8))
    assert len(g.paths) == 1 and (g.paths[0][0] == g.paths[0][-1]).all() and g.length(0) == pytest.approx(2 * np.pi * 30, rel=0.15)


@pytest.mark.parametrize(("gap", "merged"), [(6, True), (40, False)])
def test_near_junctions_merge_and_far_ones_do_not(gap, merged):
    m = np.zeros((300, 400), np.uint8)
    m[147:153, 20:380] = 255
    m[40:150, 200:202] = 255
    m[150:260, 200 + gap : 202 + gap] = 255
    g = lines.links_of(lines.prune(raster.thin(m), raster.distance(m)))
    assert (g.degree() >= 3).sum() >= 2
    assert ((lines.merge_close(g, raster.distance(m)).degree() >= 3).sum() == 1) == merged


def test_a_path_is_cut_where_its_thickness_changes():
    m = np.zeros((80, 300), np.uint8)
    m[38:42, 10:150] = 255
    m[34:46, 150:290] = 255
    g = _graph(m)
    levels = sorted(np.median(g.thickness(k)) for k in range(len(g.paths)))
    assert len(g.paths) >= 2 and levels[0] < 6 < 9 < levels[-1]


def test_classes_part_contour_from_thin_lines_and_masses_add_up():
    m = np.zeros((600, 800), np.uint8)
    m[100:106, 100:700] = m[500:506, 100:700] = 255
    m[100:506, 100:106] = m[100:506, 694:700] = 255
    for y in (200, 260, 320, 380):
        m[y : y + 2, 150:650] = 255
    g = _graph(m)
    c = lines.classify(g, m.shape, 6.0)
    assert c.threshold is not None and len(c.peaks) == 2
    assert ((c.density[1:] + c.density[:-1]) / 2 * np.diff(c.grid)).sum() == pytest.approx(1)
    painted = lines.paint(m.shape, g, c.thick)
    assert painted[102, 400] and painted[300, 102] and not painted[200:202, 300].any()
    assert lines.classify(g, m.shape, None).thick.all()


def test_trim_cuts_free_ends_only():
    p = np.column_stack([np.zeros(50, int), np.arange(50)])
    on = np.zeros(50, bool)
    on[:8] = on[40:] = True
    assert lines.trim(p, on, (True, True), 3) == (8, 40) and lines.trim(p, on, (False, True), 3) == (0, 40)
    assert lines.trim(p, np.ones(50, bool), (True, True), 3) is None
    on[20:49] = True
    on[30:32] = False
    assert lines.trim(p, on, (True, True), 3) == (8, 20)


def test_arrows_shorten_what_they_cover():
    img = _sheet(8, 1)
    img[54:62, 360:395] = 0
    arrows = np.zeros(img.shape[:2], np.uint8)
    arrows[40:75, 350:400] = 255
    out = sheets.clean(img, arrows=arrows)
    assert out["mask"][54, 100] and out["mask"][100, 54]


def test_sections_measure_a_line_at_any_angle():
    yy, xx = np.mgrid[:120, :120]
    for angle, t in ((0, 5), (0, 9), (30, 6), (45, 3)):
        a = np.radians(angle)
        ink = np.where(np.abs((yy - 60) * np.cos(a) - (xx - 60) * np.sin(a)) <= t / 2 - 0.01, 255, 0).astype(np.uint8)
        ink[:, :10] = ink[:, 110:] = 0
        g = _graph(ink)
        p = max(g.paths, key=len)
        d = p[np.minimum(np.arange(len(p)) + 3, len(p) - 1)] - p[np.maximum(np.arange(len(p)) - 3, 0)]
        tangent = d / np.hypot(*d.T)[:, None]
        got = lines.sections(p, tangent, ink, g.dist)
        assert np.median(got[10:-10]) == pytest.approx(t, abs=1.1)
    assert np.isnan(lines.sections(np.array([[60, 60]]), np.zeros((1, 2)), ink, g.dist)).all()


@settings(max_examples=40, deadline=None)
@given(hn.arrays(np.uint8, st.tuples(st.integers(4, 40), st.integers(4, 40)), elements=st.sampled_from([0, 255, 255])), st.integers(3, 17))
def test_thinning_in_tiles_is_thinning(mask, tile):
    mask[[0, -1]] = mask[:, [0, -1]] = 0
    assert (raster.thin_in_tiles(mask, raster.distance(mask), tile) == raster.thin(mask)).all()


def test_filled_outlines_and_their_extent():
    m = np.zeros((40, 60), np.uint8)
    m[5:35, 5:55] = 255
    m[8:32, 8:52] = 0
    assert (raster.filled(m)[5:35, 5:55] == 255).all() and raster.filled(m).sum() == 30 * 50 * 255
    assert shapes.extent(m) == pytest.approx(1, abs=0.1)
    cross = np.zeros((60, 60), np.uint8)
    cross[29:31] = cross[:, 29:31] = 255
    assert shapes.extent(cross) < 0.1 and shapes.extent(np.zeros((3, 3), np.uint8)) == 0
