"""Outlines and polygons."""

from __future__ import annotations

import math

import numpy as np


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise in the plane of x to the right and y up, from the smallest point."""
    p = np.asarray(points)
    if len(p) > 64:  # of points on a row only the outer two can be corners
        p = p[np.lexsort((p[:, 0], p[:, 1]))]
        new = np.flatnonzero(np.r_[True, p[1:, 1] != p[:-1, 1]])
        p = p[np.r_[new, new[1:] - 1, len(p) - 1]]
    p = sorted(set(map(tuple, p.tolist())))
    if len(p) < 3:
        return np.array(p)

    def half(q):
        out = []
        for r in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def is_convex(poly: np.ndarray) -> bool:
    d = np.roll(poly, -1, 0) - poly
    e = np.roll(d, -1, 0)
    c = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    return bool((c >= 0).all() or (c <= 0).all())


def area(poly: np.ndarray) -> float:
    if len(poly) < 3:
        return 0.0
    x, y = np.asarray(poly, float).T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def contains(poly: np.ndarray, x: float, y: float) -> bool:
    """Whether a point lies in a polygon or on its boundary."""
    a, b = np.asarray(poly, float), np.roll(np.asarray(poly, float), -1, 0)
    cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
    on = (cross == 0) & (np.minimum(a[:, 0], b[:, 0]) <= x) & (x <= np.maximum(a[:, 0], b[:, 0])) & (np.minimum(a[:, 1], b[:, 1]) <= y) & (y <= np.maximum(a[:, 1], b[:, 1]))
    if on.any():
        return True
    up = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return bool((up & (x < at)).sum() % 2)


def simplify(line: np.ndarray, eps: float, closed: bool = False) -> np.ndarray:
    """Douglas-Peucker; a closed line is parted at its two points farthest from each other first."""
    p = np.asarray(line, float)
    if closed and len(p) > 2:
        i = int(np.argmax(((p - p[0]) ** 2).sum(1)))
        j = int(np.argmax(((p - p[i]) ** 2).sum(1)))
        i, j = min(i, j), max(i, j)
        a, b = simplify(p[i : j + 1], eps), simplify(np.concatenate([p[j:], p[: i + 1]]), eps)
        return np.concatenate([a[:-1], b[:-1]])
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, q = p[b] - p[a], p[a + 1 : b] - p[a]
        n = np.hypot(*d)
        off = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / n if n else np.hypot(q[:, 0], q[:, 1])
        k = int(np.argmax(off))
        if off[k] > eps:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[sorted(keep)]


def min_area_rect(points: np.ndarray) -> np.ndarray:
    """Corners of the smallest rectangle around points: one of its sides lies along an edge of their hull."""
    h = hull(points).astype(float)
    if len(h) < 3:
        return np.array([h[0], h[-1], h[-1], h[0]])
    best, corners = np.inf, None
    for e in np.roll(h, -1, 0) - h:
        u = e / np.hypot(*e)
        v = np.array([-u[1], u[0]])
        a, b = h @ u, h @ v
        size = (a.max() - a.min()) * (b.max() - b.min())
        if size < best - 1e-9:
            best = size
            corners = np.array([u * s + v * t for s, t in ((a.min(), b.min()), (a.max(), b.min()), (a.max(), b.max()), (a.min(), b.max()))])
    return corners


def fill_convex(shape: tuple[int, int], poly: np.ndarray) -> np.ndarray:
    """Pixels whose centres lie in a convex polygon or on its boundary."""
    p = np.asarray(poly, float)
    out = np.zeros(shape, np.uint8)
    x0, y0 = np.maximum(np.ceil(p.min(0) - 1e-9), 0).astype(int)
    x1, y1 = np.minimum(np.floor(p.max(0) + 1e-9), [shape[1] - 1, shape[0] - 1]).astype(int)
    if x1 < x0 or y1 < y0:
        return out
    # each side bounds every row on one end: d_x (y - p_y) - d_y (x - p_x) has the sign of the turn, or is 0
    turn = np.sign((p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)).sum()) or 1.0
    rows = np.arange(y0, y1 + 1)
    lo, hi = np.full(len(rows), float(x0)), np.full(len(rows), float(x1))
    for (px, py), (dx, dy) in zip(p, turn * (np.roll(p, -1, 0) - p), strict=True):
        room = dx * (rows - py) + 1e-9
        if dy > 0:
            hi = np.minimum(hi, px + room / dy)
        elif dy < 0:
            lo = np.maximum(lo, px + room / dy)
        else:
            hi = np.where(room < 0, -1.0, hi)
    a, b = np.ceil(lo - 1e-9).astype(int), np.floor(hi + 1e-9).astype(int)
    step = np.zeros((len(rows), x1 - x0 + 2), np.int8)
    some = np.flatnonzero(b >= a)
    step[some, a[some] - x0] = 1
    step[some, b[some] - x0 + 1] = -1
    out[y0 : y1 + 1, x0 : x1 + 1] = np.where(np.cumsum(step, axis=1, dtype=np.int8)[:, :-1] > 0, 255, 0)
    return out


def stamp(out: np.ndarray, centres: np.ndarray, r: float) -> None:
    """Paints all pixels no farther than r from centres (x, y) on pixels or halfway between two neighbours in a diagonal."""
    for half in (0.0, 0.5):
        own = centres[(centres[:, 0] % 1 == half)]
        if not len(own):
            continue
        n = math.ceil(r + 1)
        dy, dx = np.mgrid[-n : n + 1, -n : n + 1]
        near = np.hypot(dx - half, dy - half) <= r
        low = np.floor(own).astype(int)
        for a in range(0, len(low), 1 << 16):
            x, y = (low[a : a + (1 << 16), 0][:, None] + dx[near]).ravel(), (low[a : a + (1 << 16), 1][:, None] + dy[near]).ravel()
            inside = (x >= 0) & (y >= 0) & (x < out.shape[1]) & (y < out.shape[0])
            out[y[inside], x[inside]] = 255


def draw_line(out: np.ndarray, points: np.ndarray, width: float) -> np.ndarray:
    """Paints a polyline with round ends: pixels no farther than half the width.

    Between neighbouring pixels the nearest place is a pixel of the line, or the middle of a diagonal step.
    """
    r = width / 2
    p = np.asarray(points, float)
    step = np.abs(np.diff(p, axis=0)).max(1, initial=0) if len(p) > 1 else np.zeros(0)
    if (p % 1 == 0).all():
        diagonal = (np.abs(np.diff(p, axis=0)) == 1).all(1)
        stamp(out, np.concatenate([p, (p[:-1][diagonal] + p[1:][diagonal]) / 2]), r)
        far = np.flatnonzero(step > 1)
    else:
        far = np.arange(len(step))
        if not len(far):
            return draw_line(out, np.concatenate([p, p]), width)
    for a, b in zip(p[far], p[far + 1], strict=True):
        lo = np.maximum(np.floor(np.minimum(a, b) - r), 0).astype(int)
        hi = np.minimum(np.ceil(np.maximum(a, b) + r), [out.shape[1] - 1, out.shape[0] - 1]).astype(int)
        if (hi < lo).any():
            continue
        yy, xx = np.mgrid[lo[1] : hi[1] + 1, lo[0] : hi[0] + 1]
        d = b - a
        t = np.clip(((xx - a[0]) * d[0] + (yy - a[1]) * d[1]) / max(d @ d, 1e-12), 0, 1)
        near = np.hypot(xx - a[0] - t * d[0], yy - a[1] - t * d[1]) <= r
        out[lo[1] : hi[1] + 1, lo[0] : hi[0] + 1][near] = 255
    return out


def border(mask: np.ndarray) -> np.ndarray:
    """Outer border of the component of the first ink pixel, as a ring of pixels (x, y), by following it."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.zeros((0, 2), int)
    on = np.pad(mask > 0, 1)
    start = (int(ys[0]) + 1, int(xs[0]) + 1)
    ring = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    out, at, come = [start], start, 0
    first = None
    while True:
        for k in range(1, 9):
            j = (come + k) % 8
            to = (at[0] + ring[j][0], at[1] + ring[j][1])
            if on[to]:
                break
        else:
            break
        if at == start:
            if first is None:
                first = to
            elif to == first:
                break
        out.append(to)
        at, come = to, (j + 4) % 8
    out = out[:-1] if len(out) > 1 and out[-1] == out[0] else out
    return np.array([(x - 1, y - 1) for y, x in out])


def extent(mask: np.ndarray) -> float:
    """Share of its box that the outline of a component holds."""
    ring = border(mask)
    if not len(ring):
        return 0.0
    w, h = np.ptp(ring, axis=0) + 1
    return area(ring) / float(w * h)


def clip(poly: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray | None:
    """Intersection of a polygon with a box x0, y0, x1, y1, side by side; None where nothing of it is left."""
    p = np.asarray(poly, float)
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for a, b in zip(p, np.roll(p, -1, 0), strict=True):
            ia, ib = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ia != ib:
                c = a + (bound - a[axis]) / (b[axis] - a[axis]) * (b - a)
                c[axis] = bound
                out.append(c)
            if ib:
                out.append(b)
        p = np.array(out)
        if not len(p):
            return None
    return p if area(p) > 0 else None


def fit_circle(points: np.ndarray, straight: float = 1.5, rounds: int = 10) -> tuple[np.ndarray, float, float]:
    """Centre, radius and relative error of a circle through points (x, y): sums first, then Gauss-Newton; (NaN, infinite, 0) of a straight line."""
    p = np.asarray(points, float)
    m = p.mean(0)
    q = p - m
    _, _, axes = np.linalg.svd(q, full_matrices=False)
    none = np.array([np.nan, np.nan]), np.inf, 0.0
    if len(p) < 3 or np.ptp(q @ axes[1]) <= straight:
        return none
    a = np.column_stack([2 * q, np.ones(len(q))])
    s, *_ = np.linalg.lstsq(a, (q**2).sum(1), rcond=None)
    c, r = s[:2], float(np.sqrt(max(s[2] + s[:2] @ s[:2], 0)))
    for _ in range(rounds):
        d = q - c
        n = np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-12)
        step, *_ = np.linalg.lstsq(np.column_stack([d / n[:, None], np.ones(len(q))]), n - r, rcond=None)
        c, r = c + step[:2], r + step[2]
        if np.abs(step).max() < 1e-6:
            break
    if not np.isfinite(r) or r <= 0:
        return none
    d = q - c
    return c + m, float(r), float(np.sqrt(np.mean((np.hypot(d[:, 0], d[:, 1]) - r) ** 2)) / r)
