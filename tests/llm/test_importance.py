import hashlib
import math
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from skylattice.llm import importance
from tests.compare import SMALL, connect, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target):
    """doc_id, n_features, weight, score, rank of (doc_id, text) rows, one by one; rank -1 for undrawn."""

    def buckets(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    known = [(d, *buckets(t)) for d, t in docs]
    s, t = Counter(b for _, _, bs in known for b in bs), Counter(b for x in target for b in buckets(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + 10000.0) / ((s[b] + 1.0) * (nt + 10000.0))))
    out = []
    for d, n, bs in known:
        weight = sum(map(gain, bs)) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    can = sorted((-r[4], r[0] is None, r[0] or 0, i) for i, r in enumerate(out) if r[1] >= 20)
    rank = {i: k + 1 for k, (*_, i) in enumerate(can[: 25 * len(can) // 100])}
    return [(r[0], r[2], r[3], r[4], rank.get(i, -1)) for i, r in enumerate(out)]


def found(docs, target):
    got = importance.weighted(docs, target).fillna(-1, ["rank"])
    return [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()]


key = lambda r: tuple((v is not None, v) for v in r)


def test_odd_documents(spark, odd_docs):
    target = spark.createDataFrame([("12 one Two twoé",), (None,), ("",)], "text string")
    pairs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(found(odd_docs, target), key=key) == sorted(plain(pairs, ["12 one Two twoé", None, ""]), key=key)


def test_query_equals_sql(spark):
    got = importance.query(spark, SMALL).toPandas()
    assert rows(got) == rows(connect().sql(importance.ORACLE).df())
    assert got["rank"].notna().sum() > 10


def test_draws_towards_the_target(spark):
    """Half the documents speak as the target does: nearly all that is drawn is of them; a hot id with a third of the rows is drawn whole or
    in part by its texts, ranks are 1, 2, 3... and repeated rows count each."""
    good, bad = "alpha beta gamma delta " * 6, "rho sigma tau upsilon " * 6
    data = [(i if i % 3 else 7, f"{good if i % 2 else bad} n{i % 50}") for i in range(1200)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = found(docs, spark.createDataFrame([(good,)] * 3, "text string"))
    want = plain(data, [good] * 3)
    assert sorted(r[:4] for r in got) == sorted(r[:4] for r in want)
    assert sorted(r[4] for r in got if r[4] > 0) == list(range(1, 301))
    by_rank = [r[3] for r in sorted(got, key=lambda r: r[4]) if r[4] > 0]
    assert by_rank == sorted(by_rank, reverse=True)
    of = {r[2] for r in got}
    middle = (min(of) + max(of)) / 2
    assert sum(r[2] > middle for r in got) == 600 and sum(r[2] > middle for r in got if r[4] > 0) > 270


def test_drawn_documents_keep_their_columns(spark, odd_docs):
    target = spark.createDataFrame([("etaoin",)], "text string")
    out = importance.draw(odd_docs, target)
    assert out.columns == odd_docs.columns
    ids = {r[0] for r in found(odd_docs, target) if r[4] > 0}
    assert {r["doc_id"] for r in out.collect()} == ids and ids


def test_empty_table_and_plan(spark, no_docs):
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.weighted(no_docs, target).count() == 0 and importance.draw(no_docs, target).count() == 0
    docs = spark.createDataFrame([(1, "x " * 30)], "doc_id long, text string")
    got = importance.weighted(docs, target.limit(0))
    assert got.count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", ["ÀB É ß Straße ΑΒΓ", "tab\tnew\nline\x0b", "a-b_c 1.5e3 😀x 𝒳y", " \u00a0 \u2028 z"])
def test_words_are_those_of_the_pattern(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(importance.words(importance.F.col("t"))).head()[0]
    assert got == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


def test_rerun_agrees(spark, odd_docs):
    target = spark.createDataFrame([("etaoin",)], "text string")
    a, b = (importance.weighted(d, target).toPandas().sort_values(["doc_id", "score", "rank"], ignore_index=True) for d in (odd_docs, odd_docs.repartition(7)))
    pd.testing.assert_frame_equal(a, b)
