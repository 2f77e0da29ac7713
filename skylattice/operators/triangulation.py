"""Delaunay triangles of a table of points, in tiles (operator F01).

Points are dealt into tiles of MOST points: strips by x, cut by rank of y. Each tile triangulates its own points and those of others that it
has heard of, and asks the tiles that the circles of its own points' triangles reach into for points inside (at the border, for points
beyond). A triangle whose circle no unheard point lies in is final, so a tile that learns nothing new is done; the others go round
again with what they have learnt. A round only carries shapes and the points found in them.

A group holds a tile's points, those heard of, and as many as one point has neighbours. What the driver knows is a box for each tile; MOST
grows where there would be over MOST_TILES.

Defined cases. Null id, x or y: not a point. Equal places: the least id stays. Points on one circle: ids decide, alike in every tile (places
are moved by up to 1e-10 of the extent). Fewer than three points, or all on one line: no triangles. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import delaunay
from .staging import staged

MOST, MOST_TILES = 1000, 1 << 18
#: Points that one answer brings for a circle or half-plane at most; what is left is asked for in the next round.
ANSWER = 8
#: Tiles wholly inside a shape are known to hold an answer: so many of them, the nearest, are asked.
ASKED = 4
#: First margin around a tile, in mean distances of its points.
MARGIN = 3.0
CIRCLE, SIDE, BOX = 0.0, 1.0, 2.0
#: Rounding that circles are widened by when tiles are chosen.
WIDER = 1 + 1e-9


def tiled(points: DataFrame, most: int = MOST) -> DataFrame:
    """tile, id, x, y: distinct places, tile by tile."""
    p = points.select(F.col("id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")).filter("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    p = staged(p.groupBy("x", "y").agg(F.min("id").alias("id")))
    n, x0, x1, y0, y1 = p.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    most = max(most, -(-n // MOST_TILES))
    tiny = 1e-10 * max(x1 - x0, y1 - y0) if n else 0.0
    shift = lambda seed: (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * tiny
    p = p.withColumns({"x": F.col("x") + shift(1), "y": F.col("y") + shift(2)})
    strips = max(1, round((n / most) ** 0.5))
    if strips > 1:
        cuts = p.agg(F.percentile_approx("x", [i / strips for i in range(1, strips)], 100 * strips)).head()[0]
        strip = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("x")))
    else:
        strip = F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_strip").orderBy("y", "x", "id")) - 1
    p = p.withColumn("_strip", strip).withColumn("_cut", F.floor(rank / most))
    return staged(p.select((F.col("_strip").cast("long") * (1 << 32) + F.col("_cut")).alias("tile"), "id", "x", "y"))


def _reached(shape: np.ndarray, boxes: np.ndarray, extent: float) -> np.ndarray:
    """Numbers of the boxes to ask for one shape."""
    kind, (a, b, c) = shape[0], shape[1:].reshape(3, 2)
    low, high = boxes[:, :2], boxes[:, 2:]
    if kind == BOX:
        return np.flatnonzero(((low <= b) & (high >= a)).all(axis=1))
    if kind == CIRCLE:
        mid, r2 = (v[0] for v in delaunay.circumcircles(shape[1:].reshape(3, 2), np.array([[0, 1, 2]])))
        if r2 < 1e6 * extent**2:
            near, far = np.clip(mid, low, high), np.maximum(np.abs(mid - low), np.abs(mid - high))
            meets, holds = ((near - mid) ** 2).sum(axis=1) <= r2 * WIDER, (far**2).sum(axis=1) * WIDER < r2
        else:  # nearly the half-plane beyond its longest edge, turned so that the third point is on the left
            k = int(np.argmax([((b - c) ** 2).sum(), ((c - a) ** 2).sum(), ((a - b) ** 2).sum()]))
            a, b = ((b, c), (c, a), (a, b))[k]
            reach = ((b - a) ** 2).sum() / (2 * np.sqrt(r2)) if np.isfinite(r2) else 0.0
            meets, holds = _beyond(a, b, low, high, -reach - 1e-12 * extent), _beyond(a, b, low, high, 1e-3 * extent, whole=True)
            mid = (a + b) / 2
    else:
        meets, holds, mid = _beyond(a, b, low, high, -1e-12 * extent), _beyond(a, b, low, high, 1e-12 * extent, whole=True), (a + b) / 2
    held = np.flatnonzero(holds)
    if not len(held):
        return np.flatnonzero(meets)
    return held[np.argsort(((np.clip(mid, low[held], high[held]) - mid) ** 2).sum(axis=1), kind="stable")[:ASKED]]


def _beyond(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, by: float, whole: bool = False) -> np.ndarray:
    """Whether boxes lie, in part or whole, right of the line from a to b by more than a distance."""
    n = np.array([b[1] - a[1], a[0] - b[0]]) / np.sqrt(((b - a) ** 2).sum())
    ends = np.stack([(low - a) * n, (high - a) * n])
    return (ends.min(axis=0) if whole else ends.max(axis=0)).sum(axis=1) > by


def _answers(shape: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Numbers of the points inside one shape: all of a box, else those nearest to its middle first."""
    kind, (a, b, c) = shape[0], shape[1:].reshape(3, 2)
    if kind == BOX:
        return np.flatnonzero((xy >= a).all(axis=1) & (xy <= b).all(axis=1))
    at = np.flatnonzero(delaunay.inside(a, b, c, xy) if kind == CIRCLE else delaunay.cross(b - a, xy - a) < 0)
    mid = (a + b + c) / 3 if kind == CIRCLE else (a + b) / 2
    return at[np.argsort(((xy[at] - mid) ** 2).sum(axis=1), kind="stable")[:ANSWER]]


def _sides(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half-planes right of the edges a to b."""
    return np.column_stack([np.full(len(a), SIDE), a, b, b])


def _questions(xy: np.ndarray, own: np.ndarray, box: np.ndarray, t: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Shapes in which an unheard point would change a triangle of an own point."""
    if not len(t):  # one point, or a line: points off it, or on it before and behind, are in one of the half-planes
        if len(xy) == 1:
            ends = np.array([[1.0, 0], [0, 1], [-1, 0], [0, -1]])
            return _sides(np.repeat(xy, 4, axis=0), xy + ends)
        far = xy[((xy - xy[0]) ** 2).sum(axis=1).argmax()]
        first = xy[((xy - far) ** 2).sum(axis=1).argmax()]
        turned = np.array([far[1] - first[1], first[0] - far[0]])
        return _sides(np.array([first, far, first, far]), np.array([far, first, first + turned, far - turned]))
    t = t[own[t].any(axis=1)]
    mid, r2 = delaunay.circumcircles(xy, t)
    r = np.sqrt(r2) * WIDER
    with np.errstate(invalid="ignore"):
        known = (mid - r[:, None] >= box[:2]).all(axis=1) & (mid + r[:, None] <= box[2:]).all(axis=1)
    t = t[~known]
    border = border[own[border].any(axis=1)]
    return np.vstack([np.column_stack([np.full(len(t), CIRCLE), xy[t].reshape(-1, 6)]), _sides(xy[border[:, 0]], xy[border[:, 1]])])


def _wide(box: np.ndarray, n: int) -> np.ndarray:
    """A tile's box with its first margin, inside which it hears of all points."""
    size = box[2:] - box[:2]
    m = MARGIN * max(float(size[0] * size[1] / max(n, 1)) ** 0.5, float(size.max()) / max(n, 1))
    return np.array([box[0] - m, box[1] - m, box[2] + m, box[3] + m])


ASK = "tile long, asked long, shapes binary"
FOUND = "tile long, id long, x double, y double"
STEP = "tile long, kind int, asked long, shapes binary, v0 long, v1 long, v2 long"


def _ask(tile: int, shapes: np.ndarray, tiles: np.ndarray, boxes: np.ndarray) -> list[tuple[int, bytes]]:
    """Shapes by the tile asked."""
    by: dict[int, list[np.ndarray]] = {}
    extent = float(np.sqrt(((boxes[:, 2:].max(axis=0) - boxes[:, :2].min(axis=0)) ** 2).sum()))
    for s in shapes:
        for k in _reached(s, boxes, extent):
            if tiles[k] != tile:
                by.setdefault(int(tiles[k]), []).append(s)
    return [(k, np.array(v).tobytes()) for k, v in by.items()]


def _triangles(xy: np.ndarray, ids: np.ndarray, own: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Ids of triangles, least first and then counter-clockwise, whose least id is an own point."""
    a, b, c = xy[t[:, 0]], xy[t[:, 1]], xy[t[:, 2]]
    longest = np.maximum(np.maximum(((b - a) ** 2).sum(axis=1), ((c - b) ** 2).sum(axis=1)), ((a - c) ** 2).sum(axis=1))
    v = t[np.arange(len(t))[:, None], (ids[t].argmin(axis=1)[:, None] + np.arange(3)) % 3]
    return ids[v[own[v[:, 0]] & (delaunay.cross(b - a, c - a) > 1e-8 * longest)]]


def triangles(points: DataFrame, most: int = MOST) -> DataFrame:
    """v0, v1, v2 of the Delaunay triangles of points (id, x, y): counter-clockwise, v0 the least id."""
    p = tiled(points, most)
    rows = p.groupBy("tile").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).orderBy("tile").collect()  # MOST_TILES at most, and as many as there are strips
    tiles, boxes, counts = np.array([r[0] for r in rows], np.int64), np.array([tuple(r)[1:5] for r in rows], float).reshape(-1, 4), [r[5] for r in rows]
    where = {int(t): i for i, t in enumerate(tiles)}
    held = p.sparkSession.sparkContext.broadcast((tiles, boxes, counts, where))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiles, boxes, counts, where = held.value
        for pdf in batches:
            for tile in pdf["tile"]:
                i = where[tile]
                shape = np.array([[BOX, *_wide(boxes[i], counts[i]), 0.0, 0.0]])
                yield pd.DataFrame([(tile, *a) for a in _ask(tile, shape, tiles, boxes)], columns=["tile", "asked", "shapes"])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tile, shapes, rows in zip(pdf["tile"], pdf["shapes"], pdf["rows"], strict=True):
                ids, xy = np.array([r["id"] for r in rows], np.int64), np.array([(r["x"], r["y"]) for r in rows])
                hit = np.unique(np.concatenate([_answers(s, xy) for s in np.frombuffer(shapes).reshape(-1, 7)]))
                yield pd.DataFrame({"tile": tile, "id": ids[hit], "x": xy[hit, 0], "y": xy[hit, 1]})

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles, boxes, counts, where = held.value
        tile = int(pdf["tile"].iloc[0])
        pdf = pdf.sort_values("id")
        ids, xy, own = pdf["id"].to_numpy(), pdf[["x", "y"]].to_numpy(), pdf["own"].to_numpy()
        centre = boxes[where[tile], :2]
        t, border = delaunay.with_border(xy - centre)
        shapes = _questions(xy, own, _wide(boxes[where[tile]], counts[where[tile]]), t, border)
        asks = pd.DataFrame(_ask(tile, shapes, tiles, boxes), columns=["asked", "shapes"])
        v = _triangles(xy - centre, ids, own, t)
        out = pd.concat([asks.assign(kind=0), pd.DataFrame(v, columns=["v0", "v1", "v2"]).assign(kind=1)], ignore_index=True)
        return pd.DataFrame({"tile": tile, "kind": out["kind"], "asked": out["asked"].astype("Int64"), "shapes": out["shapes"].astype(object).where(out["shapes"].notna(), None), **{c: out[c].astype("Int64") for c in ("v0", "v1", "v2")}})

    pick = lambda steps: steps.filter("kind = 1").select("v0", "v1", "v2")
    own = p.withColumn("own", F.lit(True))
    if len(tiles) < 2:  # nobody to ask
        return pick(own.groupBy("tile").applyInPandas(step, STEP))

    # A tile's points as one row: what is asked of it comes to them by a join, which adaptive execution splits where many ask one tile.
    packed = staged(p.groupBy("tile").agg(F.collect_list(F.struct("id", "x", "y")).alias("rows")).select(F.col("tile").alias("asked"), "rows"))

    def hear(asks: DataFrame) -> DataFrame:
        return asks.join(packed, "asked").select("tile", "shapes", "rows").mapInPandas(answer, FOUND).dropDuplicates(["tile", "id"])

    # Few rows, long work: adaptive execution would put all tiles into a task or two.
    tasks = max(1, min(len(tiles), 2 * p.sparkSession.sparkContext.defaultParallelism), len(tiles) // 64)
    active = p.select("tile").distinct()
    heard = staged(hear(active.mapInPandas(first, ASK)))
    done = None
    while True:
        known = own.unionByName(heard.withColumn("own", F.lit(False))).join(active, "tile", "left_semi")
        now = staged(known.repartition(tasks, "tile").groupBy("tile").applyInPandas(step, STEP))
        new = staged(hear(now.filter("kind = 0").select("tile", "asked", "shapes")).join(heard, ["tile", "id"], "left_anti").select("tile", "id", "x", "y"))
        active = new.select("tile").distinct()
        final = pick(now.join(active, "tile", "left_anti"))
        done = final if done is None else done.unionByName(final)
        if new.isEmpty():
            return done
        heard = heard.unionByName(new)
