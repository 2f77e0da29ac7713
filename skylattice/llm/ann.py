"""Nearest neighbours by largest inner product with an adaptive dimension scan.

Inner products become distances when each vector gets one more coordinate that brings all to the largest norm; lists are made around
centroids of such vectors, and a query, scaled to that norm, has 0 there. A query probes every list whose centroid is almost as near
as its nearest one. How near that is (the slack) is measured: the sample's own neighbours, found exactly, must fall into probed lists
RECALL of the time. So clustered data need few lists, and vectors without structure, whose neighbours lie in most lists, get most.

In a list, vectors and queries are rotated at random and distances grow column block by column block, as products of a block of
queries and the list's rows. After each block a candidate is abandoned when its partial distance, scaled to all dimensions, is so far
above the distance that the query's k-th best inner product so far allows that chance hardly explains it; rows and queries without a
candidate left are dropped from the products, and few candidates go on pair by pair. The k-th best among sampled rows is a query's
first threshold. Survivors are ranked by inner products of the original vectors in double precision.

Equal vectors are searched once: only the k + 1 least different ids of equal vectors can be among k nearest, so these travel with the
vector, with their numbers of rows, and equal queries share one search; of the query's own id and vector one row is its own and is
left out. Lists are put together to shards of bounded size and a larger list is cut into several, so a hot list is many tasks; a task
finds the best of one block of queries in one shard.

Defined cases. Null or zero vectors, those that hold null or non-finite components, and rows without an id take no part. Vectors of
different lengths never meet: each length is searched by itself. Repeated rows and ids: each row asks and is a candidate of all others.
Fewer than k candidates: all are returned. Ties go to the smaller id. An empty table gives an empty result. Columns other than vec_id
and embedding, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged

K, EVERY = 20, 20
#: Rows the centroids and the slack are fitted on, rows of these whose best inner products are a query's first threshold, most lists.
SAMPLE_ROWS, SEED_ROWS, MOST_LISTS = 20_000, 4096, 1024
#: Share of the sample's neighbours that probed lists must hold, queries it is measured on, least lists that a query probes.
RECALL, TRIED, PROBES = 0.95, 256, 8
#: Rows in a shard, queries in a block, queries in one product.
SHARD, QUERY_BLOCK, PRODUCT = 4096, 4096, 512
#: Columns of a block, and the width of the test: larger abandons later.
COLUMNS, WIDTH = 16, 2.1
#: Of a product's pairs, the share under which those left go on pair by pair.
FEW_LEFT = 1 / 16
SEED = 13
RESULT = "query_id long, rank int, vec_id long, score double"


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """k-means from a seeded start."""
    rng = np.random.default_rng(SEED)
    c = x[np.sort(rng.choice(len(x), n, replace=False))].copy()
    for _ in range(rounds):
        to = (x @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
        order = np.argsort(to, kind="stable")
        met, first = np.unique(to[order], return_index=True)
        c[met] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return c


def norms(x: np.ndarray) -> np.ndarray:
    """Of rows that aren't zero, however large or small."""
    most = np.abs(x).max(axis=1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


def distances(q: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Of each query, scaled to norm 1, to each centroid (which have one coordinate more)."""
    u = q / norms(q)[:, None]
    return np.sqrt(np.maximum(1 + (centers**2).sum(axis=1) - 2 * u @ centers[:, : q.shape[1]].T, 0))


def leveled(v: np.ndarray, top: float) -> np.ndarray:
    """Rows as shares of the largest norm, with the coordinate that makes their norm 1."""
    u = v / top
    return np.column_stack([u, np.sqrt(np.maximum(1 - (u**2).sum(axis=1), 0))])


def slack_of(x: np.ndarray, centers: np.ndarray, top: float, k: int) -> float:
    """How many times as far as the nearest centroid that of a neighbour's list is, at the RECALL quantile over the
    neighbours of TRIED sampled rows within the sample."""
    step, k = max(1, len(x) // TRIED), min(k, len(x) - 1)
    if k < 1:
        return 1.0
    tried = x[::step][:TRIED]
    ip = tried @ (x / top).T
    ip[np.arange(len(tried)), np.arange(len(tried)) * step] = -np.inf
    near = np.argpartition(-ip, k - 1, axis=1)[:, :k]
    to = (leveled(x, top) @ centers.T - (centers**2).sum(axis=1) / 2).argmax(axis=1)
    far = distances(tried, centers)
    least = np.maximum(far.min(axis=1, keepdims=True), 1e-300)
    return float(np.quantile(np.take_along_axis(far, to[near], axis=1) / least, RECALL))


def scan(q: np.ndarray, x: np.ndarray, turn: np.ndarray, of_list: dict[int, np.ndarray], lists: list[np.ndarray], seeds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, inner product) of each query's k best (more at a tie) of the rows of its lists. of_list: each list's rows. lists: of each
    query, nearest first. seeds: a bound for each query that its k-th best reaches anyhow, or -inf."""
    d, size, nq = x.shape[1], norms(x), norms(q)
    top = size.max()
    # Tests run on queries of norm 1 and rows of norm 1 at most, in single precision; UNSURE covers its errors.
    rq, rx = ((q / nq[:, None]) @ turn).astype(np.float32), ((x / top) @ turn).astype(np.float32)
    nx, unsure = (size / top).astype(np.float32) ** 2, np.float32(1e-5)
    best = np.full((len(q), k), -np.inf)
    floor = np.where(np.isfinite(seeds), seeds / nq / top, -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    asking: dict[int, list[int]] = {}
    for i, some in enumerate(lists):
        for one in some:
            asking.setdefault(int(one), []).append(i)

    def product(qi: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that no test has abandoned."""
        least = np.maximum(best[qi].min(axis=1), floor[qi]).astype(np.float32)
        part = np.zeros((len(qi), len(rows)), np.float32)
        allowed = 1 + nx[rows][None, :] - 2 * (least[:, None] - unsure)  # squared distance that the threshold allows
        for c in range(0, d, COLUMNS):
            e = min(c + COLUMNS, d)
            a, b = rq[qi, c:e], rx[rows, c:e]
            part += (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
            if e == d:
                break
            live = part * np.float32(d / e) <= allowed * np.float32((1 + WIDTH / np.sqrt(e)) ** 2)
            if live.sum() <= FEW_LEFT * live.size:
                i, j = np.nonzero(live)
                return pairwise(qi[i], rows[j], part[i, j], allowed[i, j], e)
            if not (use := live.any(axis=0)).all() or not live.any(axis=1).all():
                ask = live.any(axis=1)
                part, allowed, qi, rows = part[np.ix_(ask, use)], allowed[np.ix_(ask, use)], qi[ask], rows[use]
        ip = (1 + nx[rows][None, :] - part) / 2
        least = np.maximum(best[qi].min(axis=1), floor[qi])
        if len(rows) > k:  # of one list only a query's k best (or their equals) can be among its best
            least = np.maximum(least, np.partition(ip, len(rows) - k, axis=1)[:, len(rows) - k])
        i, j = np.nonzero(ip >= (least - 2 * unsure)[:, None])
        return qi[i], rows[j]

    def pairwise(i: np.ndarray, j: np.ndarray, part: np.ndarray, allowed: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        for c in range(at, d, COLUMNS):
            e = min(c + COLUMNS, d)
            part = part + ((rq[i, c:e] - rx[j, c:e]) ** 2).sum(axis=1)
            live = part * np.float32(d / e) <= allowed * np.float32((1 + WIDTH / np.sqrt(e)) ** 2 if e < d else 1) + unsure
            i, j, part, allowed = i[live], j[live], part[live], allowed[live]
        return i, j

    for one in sorted(asking, key=lambda v: np.mean([list(lists[i]).index(v) for i in asking[v][:8]])):
        rows, all_q = of_list[one], np.asarray(asking[one])
        for at in range(0, len(all_q), PRODUCT):
            i, j = product(all_q[at : at + PRODUCT], rows)
            if not len(i):
                continue
            s = (q[i] * x[j]).sum(axis=1)
            found.append((i, j, s))
            order = np.lexsort((-s, i))
            i, s = i[order], s[order] / nq[i[order]] / top
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            new = np.full((len(first), min(k, int(place.max()) + 1)), -np.inf)
            who, inside = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(i)))), place < k
            new[who[inside], place[inside]] = s[inside]
            both = np.concatenate([best[i[first]], new], axis=1)
            best[i[first]] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    i, j, s = (np.concatenate(z) for z in zip(*found, strict=True))
    keep = s / nq[i] / top >= best[i].min(axis=1) - 1e-12
    return i[keep], j[keep], s[keep]


def shards(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """First shard and number of shards of each list; lists follow each other until a shard is full."""
    out, shard, held = {}, 0, 0
    for one, n in sorted(counts.items()):
        if held and held + n > SHARD:
            shard, held = shard + 1, 0
        parts = -(-n // SHARD)
        out[one] = (shard, parts)
        held += n
        if parts > 1:
            shard, held = shard + parts, 0
    return out


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """v (doubles as bytes, null-free), its length d and norm, vec_id and n, the number of its rows with v."""

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                if v is not None and not pd.isna(i):
                    v = np.array([np.nan if z is None else z for z in v] if v.dtype == object else v, np.float64) + 0.0  # no negative zeros
                    if len(v) and np.isfinite(v).all() and v.any():
                        rows.append((int(i), len(v), float(norms(v[None])[0]), v.tobytes()))
            yield pd.DataFrame(rows, columns=["vec_id", "d", "norm", "v"])

    x = vectors.select(F.col("vec_id").cast("string"), F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(clean, "vec_id long, d int, norm double, v binary")
    return x.groupBy("v", "d", "vec_id").agg(F.count("*").alias("n"), F.max("norm").alias("norm"))


def with_ids(x: DataFrame, k: int) -> DataFrame:
    """v, d, norm and ids: the k + 1 least different ids of v, each with its number of rows (k + 1 at most)."""
    few = x.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    one = F.struct("vec_id", F.least("n", F.lit(k + 1).cast("long")).alias("n"))
    return few.groupBy("v", "d").agg(F.sort_array(F.collect_list(one)).alias("ids"), F.max("norm").alias("norm"))


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, probes: int = PROBES) -> DataFrame:
    """vectors: vec_id, embedding. The k nearest of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    small_batches(spark)
    each_id = staged(distinct_vectors(vectors))
    x = staged(with_ids(each_id, k))
    sizes = {r["d"]: (r["n"], r["top"]) for r in x.groupBy("d").agg(F.count("*").alias("n"), F.max("norm").alias("top")).toLocalIterator()}
    each = [_nearest(x, each_id, d, n, top, k, every, probes) for d, (n, top) in sorted(sizes.items())]
    return reduce(DataFrame.unionByName, each) if each else spark.createDataFrame([], RESULT)


def _nearest(x: DataFrame, each_id: DataFrame, d: int, n: int, top: float, k: int, every: int, probes: int) -> DataFrame:
    """nearest() among the n different vectors of length d."""
    x, each_id = x.filter(F.col("d") == d), each_id.filter(F.col("d") == d)
    most = 1 << 20
    some = F.pmod(F.xxhash64("v"), F.lit(most)) < int(min(1.0, 1.2 * SAMPLE_ROWS / n + 100 / n) * most)  # so that tasks send little more than is used
    sample = x.filter(some).orderBy(F.xxhash64("v"), "v").select("v").limit(SAMPLE_ROWS).toPandas()
    sampled = np.stack([np.frombuffer(b, np.float64) for b in sample["v"]]) if len(sample) else np.ones((1, d))
    turn, lists = rotation(d), int(min(MOST_LISTS, max(1, round(n**0.5)), len(sampled)))
    centers = centroids(leveled(sampled, top), lists)
    slack, probes = slack_of(sampled, centers, top, k) * (1 + 1e-9), min(probes, lists)
    half, seeding = (centers**2).sum(axis=1) / 2, sampled[:SEED_ROWS]

    def read(column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.float64).reshape(-1, d)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"list": (leveled(read(pdf["v"]), top) @ centers.T - half).argmax(axis=1), "v": pdf["v"], "ids": pdf["ids"], "counts": pdf["counts"]})

    listed = staged(x.select("v", F.col("ids.vec_id").alias("ids"), F.col("ids.n").alias("counts")).mapInPandas(assign, "list int, v binary, ids array<long>, counts array<long>"))
    place = shards({r["list"]: r["count"] for r in listed.groupBy("list").count().collect()})  # at most MOST_LISTS rows

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), PRODUCT):
                named = pdf["v"].iloc[at : at + PRODUCT]
                q = read(named)
                ip = q @ seeding.T
                ip[(q[:, None, 0] == seeding[None, :, 0]) & (q[:, None, -1] == seeding[None, :, -1])] = -np.inf  # its own vector doesn't bound it
                seeds = np.partition(ip, ip.shape[1] - k, axis=1)[:, ip.shape[1] - k] if ip.shape[1] >= k else np.full(len(q), -np.inf)
                far = distances(q, centers)
                order = np.argsort(far, axis=1, kind="stable")
                numbers = np.maximum(probes, (far <= far.min(axis=1, keepdims=True) * slack).sum(axis=1))
                for b, seed, near, m in zip(named, seeds.tolist(), order, numbers, strict=True):
                    into: dict[int, list[int]] = {}
                    for one in near[:m].tolist():
                        if one in place:
                            for s in range(place[one][0], sum(place[one])):
                                into.setdefault(s, []).append(one)
                    rows += [(s, b, seed, mine) for s, mine in into.items()]
            yield pd.DataFrame(rows, columns=["shard", "v", "seed", "lists"])

    first, parts = (F.create_map(*[F.lit(y) for one, at in place.items() for y in (one, at[i])]) for i in (0, 1))
    listed = listed.withColumn("shard", first[F.col("list")] + F.pmod(F.xxhash64("v"), parts[F.col("list")]).cast("int"))
    asking = each_id.filter(F.col("vec_id") % every == 0)
    asked = staged(asking.select("v").distinct().mapInPandas(probe, "shard int, v binary, seed double, lists array<int>"))
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    asked = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    listed = listed.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"v": [], "ids": [], "counts": [], "same": [], "score": []})
        right = right.sort_values(["list", "v"], ignore_index=True)
        of_list = {int(one): np.asarray(rows) for one, rows in right.groupby("list").indices.items()}
        lists = [[one for one in some if one in of_list] for some in left["lists"]]
        i, j, s = scan(read(left["v"]), read(right["v"]), turn, of_list, lists, left["seed"].to_numpy(), k + 1)
        least = np.array([ids[0] for ids in right["ids"]])
        order = np.lexsort((least[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.empty(0, np.int64)
        inside = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) <= k  # however many tie
        i, j, s = i[inside], j[inside], s[inside]
        own, other = left["v"].to_numpy()[i], right["v"].to_numpy()[j]
        return pd.DataFrame({"v": own, "ids": right["ids"].to_numpy()[j], "counts": right["counts"].to_numpy()[j], "same": own == other, "score": s})

    keys = ["shard", "block"]
    found = asked.select(*keys, "v", "seed", "lists").groupBy(*keys).cogroup(listed.select(*keys, "list", "v", "ids", "counts").groupBy(*keys))
    found = found.applyInPandas(search, "v binary, ids array<long>, counts array<long>, same boolean, score double")
    flat = found.select("v", "same", "score", F.explode(F.arrays_zip("ids", "counts")).alias("_x")).select("v", "same", "score", F.col("_x.ids").alias("vec_id"), F.col("_x.counts").alias("n"))
    flat = flat.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") <= k + 1)
    near = flat.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score", "same", "n"))).alias("near"))
    each = asking.select("v", F.col("vec_id").alias("query_id"), "n").join(near, "v").withColumn("_row", F.explode(F.expr("sequence(1L, n)"))).drop("_row", "n")
    left = F.expr("transform(near, e -> array_repeat(named_struct('vec_id', e.vec_id, 'score', e.score), cast(e.n as int) - if(e.same and e.vec_id = query_id, 1, 0)))")
    out = each.select("query_id", F.posexplode(F.slice(F.flatten(left), 1, k)).alias("_at", "_e"))
    return out.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), "_e.vec_id", "_e.score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return nearest(table(spark, sf_dir, "embeddings"))
