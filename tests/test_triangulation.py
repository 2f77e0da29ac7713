"""Triangles from tiles against the one-piece kernel and against all triples of points."""

import itertools

import numpy as np
import pandas as pd
import pytest

from skylattice.kernels import delaunay
from skylattice.operators import triangulation

SHAPE = "id long, x double, y double"


def found(spark, p, most):
    rows = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(p)]
    return [tuple(r) for r in triangulation.triangles(spark.createDataFrame(rows, SHAPE), most).collect()]


def test_border_and_triangles_cover_the_hull():
    p = np.random.default_rng(2).random((200, 2))
    t, border = delaunay.with_border(p)
    assert len(t) == 2 * len(p) - 2 - len(border)
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    hull = p[border]
    assert np.isclose(delaunay.cross(b - a, c - a).sum(), delaunay.cross(hull[:, 0], hull[:, 1]).sum())
    side = [delaunay.cross(q - h, p - h).min() for h, q in hull]
    assert min(side) > -1e-12
    d = ((p[None] - delaunay.circumcircles(p, t)[0][:, None]) ** 2).sum(axis=2)
    assert not (d < delaunay.circumcircles(p, t)[1][:, None] * (1 - 1e-9)).any()


@pytest.mark.parametrize("kind", ["even", "two towns", "ring", "strip"])
def test_tiles_give_the_whole_triangulation(spark, kind):
    r = np.random.default_rng(4)
    p = r.random((600, 2))
    if kind == "two towns":
        p = np.vstack([r.normal(0, 0.01, (300, 2)), r.normal(5, 1, (300, 2))])
    elif kind == "ring":  # long edges over an empty middle
        a = np.sort(r.random(300)) * 2 * np.pi
        p = (np.array([np.cos(a), np.sin(a)]) * (3 + r.random(300) / 10)).T
    elif kind == "strip":  # thin triangles along the border, with large circles
        p = p * [1.0, 1e-3]
    got = found(spark, p, 80)
    assert len(set(got)) == len(got) and set(got) == set(map(tuple, delaunay.triangulate(p).tolist()))


def test_ties_and_odd_rows(spark):
    grid = np.array(list(itertools.product(range(12), range(9))), float)
    got = np.array(found(spark, grid, 20))
    a, b, c = (grid[got[:, i]] for i in range(3))
    area = delaunay.cross(b - a, c - a)
    assert len(got) == 2 * 11 * 8 and np.allclose(area, 1)  # every square is cut once, alike in all tiles
    edges = np.sort(np.vstack([got[:, [0, 1]], got[:, [1, 2]], got[:, [2, 0]]]), axis=1)
    assert np.unique(edges, axis=0, return_counts=True)[1].max() == 2

    rows = [(1, 0.0, 0.0), (2, 4.0, 0.0), (3, 0.0, 3.0), (9, 4.0, 0.0), (2, 4.0, 0.0), (None, 5.0, 5.0), (5, None, 1.0), (6, 1.0, float("nan"))]
    assert [tuple(r) for r in triangulation.triangles(spark.createDataFrame(rows, SHAPE)).collect()] == [(1, 2, 3)]
    for few in ([], rows[:2], [(i, float(i), 2.0 * i) for i in range(40)]):
        assert triangulation.triangles(spark.createDataFrame(few, SHAPE), 10).count() == 0


def test_tiles_are_bounded_in_a_dense_place(spark):
    r = np.random.default_rng(6)
    p = np.vstack([r.normal(0, 1e-4, (2500, 2)), r.random((500, 2)), np.column_stack([np.full(600, 0.5), r.random(600)])])
    n = triangulation.tiled(spark.createDataFrame(pd.DataFrame({"id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]})), 100).groupBy("tile").count().toPandas()["count"]
    assert n.sum() == len(p) and n.max() <= 100 and len(n) < 3 * len(p) / 100
