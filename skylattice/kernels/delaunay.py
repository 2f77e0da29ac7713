"""Delaunay triangles of points in a plane by incremental insertion; what lies outside is triangles to a point at infinity."""

from __future__ import annotations

import numpy as np


def circumcircles(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of triangles t (rows of three point numbers)."""
    a, b, c = p[t[:, 0]], p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    bb, cc = (b**2).sum(axis=1), (c**2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d], axis=1)
    return a + u, (u**2).sum(axis=1)


def cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]


def inside(a: np.ndarray, b: np.ndarray, c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether q is inside the circle through a, b, c (counter-clockwise). Holds for circles of any size, as no centre is needed."""
    a, b, c = a - q, b - q, c - q
    return (a**2).sum(axis=-1) * cross(b, c) + (b**2).sum(axis=-1) * cross(c, a) + (c**2).sum(axis=-1) * cross(a, b) > 0


def _first(p: np.ndarray) -> tuple[int, int, int] | None:
    """Three points that aren't on one line, counter-clockwise."""
    far = int(((p - p[0]) ** 2).sum(axis=1).argmax())
    area = cross(p[far] - p[0], p - p[0])
    top = int(np.abs(area).argmax())
    if abs(area[top]) <= 1e-14 * ((p[far] - p[0]) ** 2).sum():
        return None
    return (0, far, top) if area[top] > 0 else (0, top, far)


def _insert(p: np.ndarray) -> np.ndarray:
    """Counter-clockwise triangles; n is the point at infinity, always last in its triangles (b, a, n) beside a border edge a to b."""
    n = len(p)
    start = _first(p)
    if start is None:
        return np.empty((0, 3), np.int64)
    a, b, c = start
    t = np.array([[a, b, c], [b, a, n], [c, b, n], [a, c, n]])
    q = np.vstack([p, np.zeros(2)])
    large = 10 * (np.ptp(p, axis=0) ** 2).sum()  # beyond it, centres lose digits

    def tests(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        mid, r2 = circumcircles(q, t)
        outer = t[:, 2] == n
        return mid, r2, outer, ~outer & ~(r2 < large)

    mid, r2, outer, wide = tests(t)
    for i in np.random.default_rng(7).permutation(n):
        if i in start:
            continue
        with np.errstate(invalid="ignore"):
            bad = ((p[i] - mid) ** 2).sum(axis=1) < r2 * (1 + 1e-12)
        at = np.flatnonzero(outer)
        e0, e1 = q[t[at, 1]], q[t[at, 0]]
        side = cross(e1 - e0, p[i] - e0)
        w = t[wide]
        bad[wide] = inside(q[w[:, 0]], q[w[:, 1]], q[w[:, 2]], p[i])
        bad[at] = (side < 0) | ((side == 0) & (((p[i] - e0) * (p[i] - e1)).sum(axis=1) < 0))
        hole = t[bad]
        edges = np.concatenate([hole[:, [0, 1]], hole[:, [1, 2]], hole[:, [2, 0]]])
        border = edges[~np.isin(edges[:, 0] * (n + 1) + edges[:, 1], edges[:, 1] * (n + 1) + edges[:, 0])]
        new = np.column_stack([border, np.full(len(border), i)])
        new = np.where((new[:, 0] == n)[:, None], new[:, [1, 2, 0]], np.where((new[:, 1] == n)[:, None], new[:, [2, 0, 1]], new))
        m, r, o, w = tests(new)
        t, mid, r2, outer, wide = np.vstack([t[~bad], new]), np.vstack([mid[~bad], m]), np.append(r2[~bad], r), np.append(outer[~bad], o), np.append(wide[~bad], w)
    return t


def with_border(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles, counter-clockwise, of distinct points, and the border's edges with the inside on their left. Slivers are kept. Points
    on one line give none of either."""
    t = _insert(points - points.mean(axis=0)) if len(points) > 2 else np.empty((0, 3), np.int64)
    outer = (t == len(points)).any(axis=1)
    return t[~outer], t[outer][:, [1, 0]]


def triangulate(points: np.ndarray) -> np.ndarray:
    """Rows of three point numbers, counter-clockwise, the least first. Equal points count once; fewer than three, or points on one
    line, give none."""
    p, first = np.unique(points, axis=0, return_index=True)
    t, _ = with_border(p)
    if not len(t):
        return np.empty((0, 3), np.int64)
    span = max(float(np.ptp(p, axis=0).max()), 1e-9)
    area = cross(p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]])
    t = t[np.abs(area) > 1e-12 * span * span]
    t = first[t]
    turn = t.argmin(axis=1)
    t = np.stack([t[np.arange(len(t)), (turn + k) % 3] for k in range(3)], axis=1)
    return t[np.lexsort(t.T[::-1])]
