import numpy as np

from skylattice.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=20, every=20):
    """The k nearest of each asking row, whose own row alone is left out; by id, a sorted list of (scores, ids) for each row."""
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None for x in v)]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    out = {}
    for at, (i, q) in enumerate(ok):
        if i % every == 0:
            s = sorted((-float(q @ v), j) for o, (j, v) in enumerate(ok) if o != at and len(v) == len(q))[:k]
            if s:
                out.setdefault(i, []).append([(j, -d) for d, j in s])
    return out


def table(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, 16))
    x = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * rng.choice([0.1, 2.0], (n, 1))
    x *= rng.uniform(0.5, 2, (n, 1))  # norms differ, so products and distances rank differently
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    hot = rows[5][1]
    rows += [(10_000 + i, hot) for i in range(300)]  # one very common vector
    rows += [(20_000, None), (20_020, [0.0] * 16), (20_040, [float("nan")] * 16), (20_060, [None] * 16), (None, hot), (20_080, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, SCHEMA)


def compare(got, want, least):
    hits = total = 0
    assert set(got) <= set(want)
    for q, (near,) in want.items():
        have = got.get(q, [])
        assert [r for _, r, _ in have] == list(range(1, len(have) + 1))
        hits += len({j for j, _ in near} & {j for j, _, _ in have})
        total += len(near)
    assert hits / total >= least


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 400)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    rows, df = table(spark, 1500)
    out = ann.nearest(df).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["rank"], r["score"]))
    v = {i: np.array(x, np.float32).astype(np.float64) for i, x in rows if i is not None and i < 20_000}
    for q, near in got.items():
        assert all(abs(s - v[q] @ v[j]) < 1e-12 for j, _, s in near)
        assert near == sorted(near, key=lambda t: (-t[2], t[0])) and q not in {j for j, _, _ in near}
    compare(got, brute(rows), 0.95)


def test_all_lists_probed_is_nearly_exact(spark):
    rows, df = table(spark, 400, 3)
    out = {}
    for r in ann.nearest(df, probes=10**6).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows)
    assert set(out) == set(want)
    assert np.mean([out[q] == [j for j, _ in near] for q, (near,) in want.items()]) > 0.9


def test_fewer_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [1.0, 0.0])], SCHEMA)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (20, 1.0), (0, 3): (2, 0.5), (20, 1): (0, 1.0), (20, 2): (1, 1.0), (20, 3): (2, 0.5)}
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [0.0]), (1, None)], SCHEMA)).count() == 0


def test_shards_cover_each_list_once():
    place = ann.shards({0: 10, 1: 9000, 2: 20_000, 3: 5, 4: 8190})
    used = [s for first, n in place.values() for s in range(first, first + n)]
    assert place[2][1] == -(-20_000 // ann.SHARD) and place[0][0] == 0 and sorted(set(used)) == list(range(max(used) + 1))
    assert len([s for s in range(place[2][0], sum(place[2])) if used.count(s) > 1]) == 0


def test_only_the_own_row_is_left_out(spark):
    """Rows of one id, equal or not, are candidates of each other; an id may be on many equal rows or on a third of all rows."""
    rng = np.random.default_rng(4)
    x = [[float(v) for v in r] for r in rng.normal(size=(200, 16)).astype(np.float32)]
    rows = list(enumerate(x, 1)) + [(1000, [4 * v for v in x[0]])] * 30 + [(20, x[19])] * 2
    rows += [(2000, [float(3 * a) for a in r]) for r in rng.normal(size=(100, 16)).astype(np.float32)] + [(7, x[30])] * 25
    rows += [(3000 + i, [1.0, float(i)]) for i in range(0, 90, 3)]  # vectors of another length meet each other
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), probes=10**6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    want = brute(rows)
    told = {i: sorted((n, j, round(s, 9)) for near in each for n, (j, s) in enumerate(near, 1)) for i, each in want.items()}
    assert set(got) == set(told) and all(len(got[i]) == len(told[i]) for i in told)
    assert np.mean([sorted(got[i]) == told[i] for i in told]) > 0.8


def test_two_rows_of_one_id_and_a_third(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.6, 0.8])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 1, 0.6), (0, 1, 1, 0.8), (0, 2, 0, 0.0), (0, 2, 0, 0.0)]


def test_ties_across_shards_and_clashing_columns(spark, monkeypatch):
    """60 vectors of equal score beyond rank 5, in several shards: the smallest ids come. Other columns have names the search uses."""
    monkeypatch.setattr(ann, "SHARD", 16)
    rows = [(0, [1.0] + [0.0] * 15)] + [(i, [2.0] + [0.0] * 15) for i in range(101, 106)]
    rows += [(i, [0.5] + [float(np.cos(i * j)) for j in range(15)]) for i in range(1, 61)]
    df = spark.createDataFrame([(i, v, None, "a", 1, 2.0, [3]) for i, v in rows], SCHEMA + ", v string, list string, shard int, norm double, ids array<int>")
    got = [r["vec_id"] for r in ann.nearest(df, probes=10**6).orderBy("rank").collect() if r["query_id"] == 0]
    assert got == [101, 102, 103, 104, 105, *range(1, 16)]


def test_extreme_norms_do_not_break_the_search(spark):
    rows = [(i, [float(i + 1) * 10.0**-30, 10.0**-30]) for i in range(40)] + [(100 + i, [10.0**30, -(10.0**29) * i]) for i in range(5)]
    got = [r["vec_id"] for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).filter("query_id = 20").orderBy("rank").collect()]
    assert got == [100, 101, 102]
