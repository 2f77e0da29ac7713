"""Joins in space by grid cells: radius, nearest neighbours, point in polygon."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def _cells(xyz: tuple[str, str, str], size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long").alias(f"_c{i}") for i, c in enumerate(xyz)]


def _around(df: DataFrame, xyz: tuple[str, str, str], size: float) -> DataFrame:
    """df's rows in their cell and in its neighbours."""
    cells, step = _cells(xyz, size), F.sequence(F.lit(-1), F.lit(1))
    for i, c in enumerate(cells):
        df = df.withColumn("_s", F.explode(step)).withColumn(f"_c{i}", c + F.col("_s")).drop("_s")
    return df


#: Rows of left that a part of a cell holds in radius_pairs(), on average.
PART = 500


def radius_pairs(left: DataFrame, right: DataFrame, lx: tuple[str, str, str], rx: tuple[str, str, str], radius: float) -> DataFrame:
    """All pairs at most radius apart, with d2, the squared distance. Column names of both sides must differ. Cells with many rows of
    left are dealt to many tasks, as every row may have many partners."""
    cells = ["_c0", "_c1", "_c2"]
    a = left.select("*", *_cells(lx, radius))
    n = a.groupBy(cells).agg(F.ceil(F.count("*") / PART).cast("int").alias("_n"))
    a = a.join(n, cells).withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.col("_n")).cast("int")).drop("_n")
    b = _around(right, rx, radius).join(n, cells).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    d2 = sum((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(lx, rx, strict=True))
    by = [*cells, "_part"]
    tasks = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as the pairs are many more than the rows
    return a.repartition(tasks, *by).join(b.repartition(tasks, *by), by).drop(*by).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)


#: Rows of a side that a task's group of nearest() holds at most, on average; cells with more are split by hash.
GROUP = 20_000
LEFT_BLOCK, RIGHT_BLOCK = 256, 64


def _blocks(p: np.ndarray, size: int) -> np.ndarray:
    """An order of points in which runs of `size` lie close together: strips by x, cut by y, cut by z."""
    at, c = np.arange(len(p)), int(np.ceil(np.ceil(len(p) / size) ** (1 / 3)))
    order = np.argsort(p[:, 0], kind="stable")
    for axis, run in ((1, size * c * c), (2, size * c)):
        order = order[np.lexsort((p[order, axis], at // run))]
    return order


def _search(left: np.ndarray, right: np.ndarray, tie: np.ndarray, k: int, r2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of left, rows of right and squared distances of the k nearest within the radius (by distance, then tie). Blocks of right whose
    box is farther from a block of left than k points are known to be aren't looked at."""
    lo, ro = _blocks(left, LEFT_BLOCK), _blocks(right, RIGHT_BLOCK)
    starts = np.arange(0, len(ro), RIGHT_BLOCK)
    low, high = (f.reduceat(right[ro], starts, axis=0) for f in (np.minimum, np.maximum))
    found = []
    for at in range(0, len(lo), LEFT_BLOCK):
        some = lo[at : at + LEFT_BLOCK]
        p = left[some]
        gap = np.maximum(np.maximum(low - p.max(axis=0), p.min(axis=0) - high), 0.0)
        away = (gap * gap).sum(axis=1)

        def distances(blocks):
            j = (starts[blocks, None] + np.arange(RIGHT_BLOCK)).ravel()
            j = ro[j[j < len(ro)]]
            d = p[:, None, :] - right[j][None, :, :]
            return j, d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]

        bound, first = r2, np.argsort(away, kind="stable")[: 1 + k // RIGHT_BLOCK + 1]
        j, d2 = distances(first)
        if len(j) >= k:
            bound = min(bound, np.partition(d2, k - 1, axis=1)[:, k - 1].max())
        near = np.flatnonzero(away <= bound * (1 + 1e-9))
        if not len(near):
            continue
        j, d2 = distances(near)
        most = np.minimum(np.partition(d2, k - 1, axis=1)[:, k - 1], r2) if len(j) >= k else np.full(len(p), r2)
        a, b = np.nonzero(d2 <= most[:, None])
        order = np.lexsort((tie[j[b]], d2[a, b], a))
        a, b = a[order], b[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        a, b = a[place < k], b[place < k]
        found.append((some[a], j[b], d2[a, b]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _k_within(places: DataFrame, right: DataFrame, rid: str, lx: tuple[str, str, str], rx: tuple[str, str, str], k: int, radius: float) -> DataFrame:
    """places with the k nearest rows of right within the radius, d2 and rank. A cell's places and its neighbours' rows of right meet in one
    task; cells with many are split on both sides, and the parts' k nearest compared."""
    cells = ["_c0", "_c1", "_c2"]
    a = places.select("*", *_cells(lx, radius))
    b = _around(right, rx, radius)
    n = a.groupBy(cells).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_nl")).join(b.groupBy(cells).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_nr")), cells)
    some = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    n = staged(n)
    a = a.join(n, cells).withColumn("_l", F.pmod(F.xxhash64(*lx), F.col("_nl")).cast("int")).withColumn("_r", some("_nr")).drop("_nl", "_nr")
    b = b.join(n, cells).withColumn("_r", F.pmod(F.xxhash64(rid, *rx), F.col("_nr")).cast("int")).withColumn("_l", some("_nl")).drop("_nl", "_nr")
    kept = right.columns
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in (*places.schema.fields, *right.schema.fields)] + ["d2 double"]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        points = lambda t, c: np.column_stack([t.column(v).to_numpy() for v in c])
        none = not len(x) or not len(y)
        tie = np.unique(y.column(rid).to_numpy(), return_inverse=True)[1]
        i, j, d2 = (np.zeros(0, int), np.zeros(0, int), np.zeros(0)) if none else _search(points(x, lx), points(y, rx), tie, k, radius * radius)
        out = {c: x.column(c).take(pa.array(i)) for c in lx} | {c: y.column(c).take(pa.array(j)) for c in kept}
        return pa.table(out | {"d2": pa.array(d2, pa.float64())})

    by = [*cells, "_l", "_r"]
    got = a.groupBy(by).cogroup(b.groupBy(by)).applyInArrow(run, ", ".join(schema))
    w = Window.partitionBy(*lx).orderBy("d2", rid)
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(left: DataFrame, right: DataFrame, key: str, rid: str, lx: tuple[str, str, str], rx: tuple[str, str, str], k: int, radius: float, longest: float) -> DataFrame:
    """The k nearest rows of right for each row of left (by `key`, which must be unique), ties to the smaller rid. Rows that find fewer
    than k within the radius look again within twice the radius, up to `longest`. Each round is written, so that the next one starts
    from the rows that are left and doesn't compute the former ones again.

    Rows of left at one place are searched once; of rows of right at one place only the k smallest can be among the nearest."""
    finite = lambda df, c: df.filter(" AND ".join(f"abs({v}) < double('infinity')" for v in c))
    here = Window.partitionBy(*rx).orderBy(rid)
    right = staged(finite(right, rx).withColumn("_n", F.row_number().over(here)).filter(F.col("_n") <= k).drop("_n"))
    left = staged(left)  # places come back as keys below, so they are computed once
    out, todo = None, staged(finite(left, lx).select(*lx).distinct())
    while True:
        best = staged(_k_within(todo, right, rid, lx, rx, k, radius))
        done = best.filter(F.col("rank") == k).select(*lx) if radius < longest else None
        got = best.join(done, list(lx), "left_semi") if done is not None else best
        out = got if out is None else out.unionByName(got)
        if done is None:
            break
        todo, radius = staged(todo.join(done, list(lx), "left_anti")), radius * 2
        if todo.limit(1).count() == 0:
            break
    return left.join(out, list(lx)).select(*left.columns, *right.columns, "d2", "rank")


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test: whether (x, y) lies in the ring, an array of structs x, y, closed by itself."""
    n = F.size(ring)
    edge = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i % n + 1).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edge, crosses)) % 2 == 1


def in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, order: str) -> DataFrame:
    """points with the first polygon (by order, then its other columns) that holds each. polygons: ring and other columns. A cell of one
    unit of x has the list of the polygons that reach into it, so one row comes out for each point, and repeated points stay."""
    low, high = (F.floor(f(F.transform("ring", lambda p: p["x"]))).cast("long") for f in (F.array_min, F.array_max))
    kept = [c for c in polygons.columns if c != "ring"]
    row = F.struct(order, *[c for c in kept if c != order], "ring")
    p = polygons.withColumn("_cell", F.explode(F.sequence(low, high))).groupBy("_cell").agg(F.collect_list(row).alias("_some"))
    got = points.withColumn("_cell", F.floor(F.col(x)).cast("long")).join(p, "_cell")
    best = F.array_min(F.filter("_some", lambda r: inside(F.col(x), F.col(y), r["ring"])))
    got = got.select(*points.columns, best.alias("_best")).filter(F.col("_best").isNotNull())
    return got.select(*points.columns, *[F.col(f"_best.{c}").alias(c) for c in kept])
