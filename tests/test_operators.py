"""Joins in time and space against plain loops, with repeated rows, ties, nulls and empty tables."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.kernels import ambiguity, orbits
from skylattice.streaming import processors
from skylattice.operators import spatial, staging, timejoin

LEFT, RIGHT = "k string, t double, name string", "k string, at double, rank long, value double"


def tables(spark, n=150, seed=3):
    r = random.Random(seed)
    left = [(r.choice("abc"), float(r.randrange(200)), "x" * r.randrange(3)) for _ in range(n)]
    left += left[:20] + [(None, 5.0, "n"), ("a", None, "n")]  # repeated rows, and rows that can't match
    right = [(r.choice("ab"), float(r.randrange(0, 200, 3)), r.randrange(4), r.random()) for _ in range(n // 2)] + [("b", None, 1, 1.0), (None, 5.0, 1, 1.0)]
    return left, right, spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)


@pytest.mark.parametrize("few", [0, 12, 128])  # buckets all sorted together, of both ways, all by lists
@pytest.mark.parametrize("before_only", [False, True])
def test_nearest_in_time(spark, monkeypatch, before_only, few):
    monkeypatch.setattr(timejoin, "FEW", few)
    left, right, a, b = tables(spark)
    want = []
    for k, t, name in left:
        near = [(-abs(at - t), rank, at) for kk, at, rank, _ in right if None not in (k, t, at) and kk == k and abs(at - t) <= 7 and not (before_only and at >= t)]
        want += [(k, t, name, max(near)[2], max(near)[1])] if near else []
    got = timejoin.nearest(a, b, ["k"], "t", "at", 7.0, [F.col("rank")], before_only)
    assert got.columns == ["k", "t", "name", "at", "rank", "value"]
    assert sorted((r.k, r.t, r.name, r["at"], r["rank"]) for r in got.collect()) == sorted(want) and len(want) > 60
    assert timejoin.nearest(a.limit(0), b, ["k"], "t", "at", 7.0, [F.col("rank")]).count() == 0
    assert timejoin.nearest(a, b.limit(0), ["k"], "t", "at", 7.0, [F.col("rank")]).count() == 0


def test_dense_bucket_takes_linear_time(spark):
    """n rows a side in one bucket of one key: four times the rows take well under sixteen times the seconds."""
    took = {}
    for n in (8_000, 8_000, 32_000):  # the first one warms up
        a = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 0.01).alias("t"))
        b = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 0.01 + 0.003).alias("at"), F.lit(1).alias("rank"))
        start = time.time()
        got = timejoin.nearest(a, b, ["k"], "t", "at", 1000.0, [F.col("rank")]).agg(F.count("*").alias("n"), F.max(F.abs(F.col("t") - F.col("at"))).alias("gap")).head()
        took[n] = time.time() - start
        assert got["n"] == n and abs(got["gap"] - 0.003) < 1e-9
    assert took[32_000] < 6 * took[8_000]


def test_brackets_cross_buckets(spark):
    rows = [("a", float(t), float(t * t)) for t in (0, 1, 9, 11, 19, 21, 40, 41)] + [("b", 5.0, 1.0)]
    got = timejoin.brackets(spark.createDataFrame(rows, "k string, t double, v double"), ["k"], "t", ["v"], 10.0)
    want = {("a", x, y if y - x <= 10 else None, y * y if y - x <= 10 else None) for x, y in itertools.pairwise([r[1] for r in rows if r[0] == "a"])} | {("a", 41.0, None, None), ("b", 5.0, None, None)}
    assert {(r["k"], r["t"], r["next_t"], r["next_v"]) for r in got.collect()} == want


def test_brackets(spark):
    left, right, a, b = tables(spark, 200, 4)
    at = {}
    for k, t, _, v in right:
        if None not in (k, t):
            at.setdefault(k, {}).setdefault(t, v)
    one = b.filter("k IS NOT NULL AND at IS NOT NULL").dropDuplicates(["k", "at"])
    at = {k: dict(sorted((r["at"], r["value"]) for r in one.collect() if r["k"] == k)) for k in at}
    want = []
    for k, t, name in left:
        times = list(at.get(k, {}))
        for x, y in itertools.pairwise(times):
            if t is not None and x <= t < y and y - x <= 6:
                want.append((k, t, name, round(at[k][x] + (t - x) / (y - x) * (at[k][y] - at[k][x]), 9)))
    got = timejoin.interpolated(a, one, ["k"], "t", "at", ["value"], 6.0).collect()
    assert sorted((r["k"], r["t"], r["name"], round(r["value"], 9)) for r in got) == sorted(want) and len(want) > 40


def test_intervals(spark):
    left, _, a, _ = tables(spark, 150, 5)
    r = random.Random(6)
    spans = [(r.choice("ab"), s, s + r.choice([0.0, 3.0, 40.0, 150.0]), i) for i in range(60) for s in [float(r.randrange(200))]]
    table = spark.createDataFrame(spans, "k string, start double, end double, row long")
    want = []
    for k, t, name in left:
        hit = [(i, s, e) for kk, s, e, i in spans if kk == k and t is not None and s <= t <= e]
        want += [(k, t, name, *min(hit))] if hit else []
    got = timejoin.valid_at(a, table, ["k"], "t", "start", "end", "row", 40.0)
    assert got.columns == ["k", "t", "name", "start", "end", "row"]
    assert sorted((r["k"], r["t"], r["name"], r["row"], r["start"], r["end"]) for r in got.collect()) == sorted(want) and len(want) > 80


def test_polygons_keep_repeated_points(spark):
    ring = lambda x, n: (n, [(x, 0.0), (x + 2.0, 0.0), (x + 1.0, 3.0)])
    polygons = spark.createDataFrame([ring(0.0, 2), ring(0.5, 1), ring(50.0, 3)], "n long, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 0.3, 0.2), (3, 9.0, 9.0), (4, None, 1.0)], "id long, x double, y double")
    got = spatial.in_polygons(points, polygons, "x", "y", "n")
    assert sorted((r["id"], r["n"]) for r in got.collect()) == [(1, 1), (1, 1), (2, 2)]
    assert spatial.in_polygons(points, polygons.limit(0), "x", "y", "n").count() == 0


def test_nearest_in_space(spark):
    rng = np.random.default_rng(1)
    p, q = rng.uniform(0, 1000, (60, 3)), np.concatenate([rng.uniform(0, 1000, (150, 3)), rng.uniform(5000, 5100, (3, 3))])
    q[7] = q[8]  # a tie
    left = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "lid long, lx double, ly double, lz double")
    right = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], "rid long, rx double, ry double, rz double")
    got = spatial.nearest(left, right, "lid", "rid", ("lx", "ly", "lz"), ("rx", "ry", "rz"), 3, 40.0, 20_000.0).collect()
    want = [(i, r, j) for i, x in enumerate(p) for r, (_, j) in enumerate(sorted((float(((x - y) ** 2).sum()), j) for j, y in enumerate(q))[:3], 1)]
    assert sorted((r["lid"], r["rank"], r["rid"]) for r in got) == want


@pytest.mark.parametrize("group", [7, 20_000])
def test_nearest_in_space_where_cells_are_split(spark, monkeypatch, group):
    monkeypatch.setattr(spatial, "GROUP", group)
    rng = np.random.default_rng(2)
    p, q = rng.integers(0, 4, (90, 3)) * 10.0, np.concatenate([rng.integers(0, 4, (120, 3)) * 10.0 + 3.0, np.full((40, 3), 500.0)])  # copies and ties on both sides
    left = spark.createDataFrame([*((i, *map(float, x)) for i, x in enumerate(p)), (900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0)], "lid long, lx double, ly double, lz double")
    right = spark.createDataFrame([*((i, *map(float, x)) for i, x in enumerate(q)), (900, float("nan"), 1.0, 1.0), (901, 1.0, None, 1.0)], "rid long, rx double, ry double, rz double")
    got = spatial.nearest(left, right, "lid", "rid", ("lx", "ly", "lz"), ("rx", "ry", "rz"), 4, 15.0, 20_000.0).collect()
    want = [(i, r, j, d) for i, x in enumerate(p) for r, (d, j) in enumerate(sorted((float(((x - y) ** 2).sum()), j) for j, y in enumerate(q))[:4], 1)]
    assert sorted((r["lid"], r["rank"], r["rid"], r["d2"]) for r in got) == want


def test_nearest_in_one_crowded_cell(spark):
    """Without all pairs: 16 * 10^8 here."""
    n = 40_000
    rows = spark.range(n).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) / 1e3).alias(c) for i, c in enumerate("abc")])
    left = rows.select(F.col("id").alias("lid"), F.col("a").alias("lx"), F.col("b").alias("ly"), F.col("c").alias("lz"))
    right = rows.select(F.col("id").alias("rid"), (F.col("b") + 1.0).alias("rx"), F.col("a").alias("ry"), F.col("c").alias("rz"))
    got = spatial.nearest(left, right, "lid", "rid", ("lx", "ly", "lz"), ("rx", "ry", "rz"), 2, 40_000.0, 80_000.0).toPandas()
    assert len(got) == 2 * n
    q = right.toPandas()
    for _, g in got[got["lid"] % 997 == 0].groupby("lid"):
        d2 = sum((q[f"r{c}"] - g[f"l{c}"].iloc[0]) ** 2 for c in "xyz")
        assert np.allclose(sorted(g["d2"]), np.sort(d2)[:2], rtol=1e-12)


def test_radius_pairs_deal_a_crowded_cell(spark):
    rows = spark.range(1300).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 20)) / 1e5).alias(c) for i, c in enumerate("xyz")])
    left = rows.select(F.col("id").alias("lid"), *[F.col(c).alias(f"l{c}") for c in "xyz"])
    got = spatial.radius_pairs(left, rows, ("lx", "ly", "lz"), ("x", "y", "z"), 30.0).withColumn("task", F.spark_partition_id())
    n = got.groupBy("task").count().toPandas()["count"]
    assert n.sum() == 1300 * 1300 and len(n) > 1 and n.max() < n.sum()  # one cell, several tasks


def test_octets_read_their_data_once(spark):
    from skylattice.functions import bits

    calls = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def counted(x):
        calls.add(1)
        return x

    got = spark.createDataFrame([(bytes(range(256)),), (b"",), (None,)], "b binary").select(bits.octets(counted("b")).alias("o")).collect()
    assert [r["o"] for r in got] == [list(range(256)), [], None]
    assert calls.value <= 6
    assert spark.range(1).select(bits.xor_checksum(F.lit("")).alias("x"), bits.crc24q(F.lit(b"123456789")).alias("c")).head() == ("00", 0xCDE703)


def test_throttled_in_batch_passes_once_over_many_keys(spark):
    rows = [(k, float(t), t % 3) for k in [None, *range(40)] for t in sorted({(7 * (k or 0) + 13 * i * i) % 300 for i in range(30)})]
    df = spark.createDataFrame(rows, "k long, t double, x long")
    got = processors.throttled(df, "k", "t", 50.0)
    want, last = [], {}
    for k, t, x in sorted(rows, key=lambda r: r[1]):
        if k not in last or t - last[k] >= 50.0:
            last[k] = t
            want.append((k, t, x))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # a group for each key cost a millisecond


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())
    Context.master = "local[4]"
    assert staging.shared_dir(Session())


@pytest.mark.parametrize("n", range(1, 7))
def test_reduction_keeps_the_lattice_and_finds_the_nearest(n):
    """Against all integers around the float vector; the basis change is whole, with determinant 1 or -1."""
    rng = np.random.default_rng(n)
    for _ in range(8):
        b = rng.normal(size=(n, n))
        q, a = b @ b.T * 0.02 + np.eye(n) * 0.01, rng.normal(size=n) * 2
        r = ambiguity.basis(q)
        short, z = ambiguity.reduced(r)
        assert np.allclose(r.T @ r, np.linalg.inv(q)) and np.array_equal(z, np.rint(z)) and abs(abs(np.linalg.det(z)) - 1) < 1e-6
        assert np.allclose(short.T @ short, (r @ z).T @ (r @ z)) and np.abs(np.triu(short, 1) / np.diag(short)[:, None]).max(initial=0) <= 0.5 + 1e-9
        around = np.array(list(itertools.product(*[range(round(v) - 2, round(v) + 3) for v in a])))
        all_ = np.sort((((around - a) @ r.T) ** 2).sum(axis=1))[:2]
        best, s = ambiguity.resolve(a, q)
        assert np.allclose(s, all_) and np.isclose(((best[0] - a) @ np.linalg.inv(q) @ (best[0] - a)), s[0])


def test_a_search_without_end_finds_nothing():
    found, s = ambiguity.search(np.eye(8) * 1e-3, np.full(8, 0.5), most=50)
    assert len(found) == 0 and len(s) == 0 and not ambiguity.accepted(s)
    with pytest.raises(np.linalg.LinAlgError):
        ambiguity.resolve(np.zeros(2), -np.eye(2))


def test_polynomials_are_met_exactly():
    x = np.array([-3.0, -1.5, 0.5, 2.0])
    assert np.allclose(orbits.through(x, np.stack([x**3 - 2, x], axis=1)), [-2, 0]) and orbits.through(np.array([-1.0, 0.0, 1.0]), np.array([5.0, 7.0, 1.0])) == 7


def test_a_full_turn_of_the_satellite_is_one_cycle():
    sat, rcv, w = np.array([0.0, 0, 2e7]), np.zeros(3), 0.0
    north, west = np.array([1.0, 0, 0]), np.array([0.0, 1, 0])
    for a in np.linspace(0, 2 * np.pi, 37):
        ex, ey = np.array([np.cos(a), np.sin(a), 0]), np.array([np.sin(a), -np.cos(a), 0])
        w = orbits.windup(sat, rcv, ex, ey, north, west, w)
    assert abs(abs(w) - 1) < 1e-9


def test_broadcast_orbit_columns_equal_the_kernel(spark):
    from skylattice.functions import orbit

    rng = np.random.default_rng(2)
    n = 40
    eph = {c: rng.uniform(-1e-6, 1e-6, n) for c in orbit.ELEMENTS} | {"a": rng.uniform(2.6e7, 2.7e7, n), "e": rng.uniform(0, 0.02, n), "toe": rng.integers(0, 600_000, n).astype(float)}
    eph |= {c: rng.uniform(-3, 3, n) for c in ("i0", "omg0", "omg", "m0")} | {"omgd": rng.uniform(-9e-9, 0, n), "idot": rng.uniform(-1e-10, 1e-10, n), "deln": rng.uniform(4e-9, 5e-9, n)}
    eph |= {c: rng.uniform(-300, 300, n) for c in ("crc", "crs")}
    t = eph["toe"] + rng.uniform(-7200, 7200, n)
    rows = [(i, float(t[i]), *(float(eph[c][i]) for c in orbit.ELEMENTS)) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, t double, " + ", ".join(f"{c} double" for c in orbit.ELEMENTS)).select("i", "t", F.struct(*orbit.ELEMENTS).alias("e"))
    got = df.select("i", orbit.satellite(F.col("e"), F.col("t")).alias("s")).select("i", "s.*").orderBy("i").toPandas()
    p, clock = orbits.broadcast_position(eph | {"toc": eph["toe"], "toes": eph["toe"]}, t)
    assert np.abs(got[["x", "y", "z"]].to_numpy() - p).max() < 1e-5 and np.allclose(got["clock"], clock, rtol=1e-12, atol=1e-15)


def test_many_epochs_at_once_equal_one_by_one():
    from skylattice.kernels import positioning

    rng, epochs, want = np.random.default_rng(4), [], []
    for i in range(12):
        rr = positioning.ecef(*rng.uniform(-1, 1, 2), rng.uniform(0, 1000))
        sat = positioning.constellation(600.0 * i)
        sat = sat[positioning.elevation(sat, rr) > 0.2][: 3 if i == 5 else 20]
        clock, delay, w = rng.uniform(-1e5, 1e5, len(sat)), rng.uniform(0, 20, len(sat)), rng.uniform(0.5, 2, len(sat))
        p = positioning.ranges(sat, rr)[0] + 77.0 + i - clock + delay + rng.normal(0, 3, len(sat))
        epochs.append(np.column_stack([p, sat, clock, delay, w]))
        one = positioning.single_point(p - delay, sat, clock / positioning.C, np.zeros(len(sat), int), 1 / w, limit=np.inf)
        want.append([*one.position, one.clocks[0]] if one.ok else [np.nan] * 4)
    epochs.append(np.empty((0, 7)))
    got = positioning.points(epochs)
    assert np.isnan(got["x"][[5, 12]]).all() and got["n"].tolist() == [len(e) for e in epochs]
    assert np.allclose(np.stack([got[c] for c in ("x", "y", "z", "dt")], axis=1)[:12], want, atol=1e-3, equal_nan=True)
    assert len(positioning.points([])["x"]) == 0


def test_positions_skip_what_they_cannot_use(spark):
    """Rows without an ephemeris or a range, a null satellite, a repeated observation: no crash, the others solve."""
    from skylattice.operators import pointing
    from skylattice.plans import chain
    from tests.compare import SMALL

    obs, eph = chain.observations(spark, SMALL).filter("t = 900 AND srcid IN (1, 2)"), chain.ephemerides(spark)
    odd = obs.unionAll(obs.filter("srcid = 1").limit(1)).unionAll(spark.sql("select 1L srcid, 900D t, 77L sat, 2e7D p union all select 1L, 900D, null, 2e7D union all select 2L, 900D, 3L, null union all select 9L, 900D, 3L, 2e7D"))
    got = {r["srcid"]: r for r in pointing.single_points(odd, eph).collect()}
    want = {r["srcid"]: r for r in pointing.single_points(obs, eph).collect()}
    assert set(want) == {1, 2} and all(abs(got[i][c] - want[i][c]) < 1e-4 for i in want for c in "xyz") and 9 not in got
    assert pointing.single_points(obs.limit(0), eph).count() == 0


def test_observations_of_the_chain_keep_their_own_light_time(spark, tmp_path):
    """Each range is what its satellite's place and clock at the time of sending give, to a millionth of a metre; a further round changes nothing."""
    from skylattice.plans import chain

    spark.createDataFrame([(7, 1234.5), (8, -20.25)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    three = {(r.srcid, r.t, r.sat): r.p for r in chain.observations(spark, str(tmp_path)).collect()}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chain, "ROUNDS", 4)
        four = {(r.srcid, r.t, r.sat): r.p for r in chain.observations(spark, str(tmp_path)).collect()}
    assert three.keys() == four.keys() and len(three) > 30
    assert max(abs(three[k] - four[k]) for k in three) < 1e-6


def test_solver_takes_epochs_of_no_rows_and_of_null(spark):
    from skylattice.operators import pointing

    kind = "srcid long, t double, o array<struct<sat: long, p: double, sx: double, sy: double, sz: double, sclock: double, delay: double, weight: double>>"
    got = pointing.solved(spark.createDataFrame([(1, 0.0, []), (2, 0.0, None), (3, 0.0, [(1, 2e7, 2.6e7, 0.0, 0.0, 0.0, 0.0, 1.0)])], kind)).collect()
    assert [(r.srcid, r.x, r.rms, r.n) for r in sorted(got, key=lambda r: r.srcid)] == [(1, None, None, 0), (2, None, None, 0), (3, None, None, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_integers_from_the_last_reduction_are_the_same(seed):
    """A lattice that has changed a little is reduced from where the last one ended: same integers and distances, and hardly a round."""
    rng = np.random.default_rng(seed)
    lower = np.tril(rng.normal(size=(9, 9)), -1) * 3 + np.diag(rng.uniform(0.01, 3, 9))
    q, a, kept, seen = lower @ lower.T, rng.normal(0, 50, 9), [], []
    ambiguity.resolve(a, q, turned=kept)
    near = q * 1.01
    with pytest.MonkeyPatch.context() as patch:
        plain = ambiguity.reduced
        patch.setattr(ambiguity, "reduced", lambda r: seen.append(plain(r)) or seen[-1])
        best, s = ambiguity.resolve(a, near, turned=kept)
    want, far = ambiguity.resolve(a, near)
    assert np.array_equal(best, want) and np.allclose(s, far, rtol=1e-6)
    assert np.array_equal(np.abs(seen[0][1]), np.eye(9)) and abs(abs(np.linalg.det(kept[0])) - 1) < 1e-6
    ambiguity.resolve(a[:4], q[:4, :4], turned=kept)  # of another size: from the start
    assert kept[0].shape == (4, 4)
