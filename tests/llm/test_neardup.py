import random

import numpy as np

from skylattice.llm import neardup
from skylattice.llm.hashing import as_bytes, word_bounds, word_hashes
from tests.llm.conftest import prose


def hashes(text):
    x = as_bytes(text)
    return word_hashes(x, *word_bounds(x))


def common(a, b):
    """Longest common subsequence by the plain table."""
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def test_alignment_equals_the_plain_table():
    r = random.Random(2)
    for _ in range(120):
        a = np.array(r.sample(range(200), r.randint(1, 40)), np.uint32)
        b = list(a)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 2)] = [r.randint(300, 10_000) for _ in range(r.randint(0, 2))]
        if r.random() < 0.3:
            k = r.randrange(len(b) + 1)
            b = b[k:] + b[:k]
        b = np.array(list(dict.fromkeys(b)) or [1], np.uint32)
        n = common(a.tolist(), b.tolist())
        assert neardup.reaches(a, b) == (n / (len(a) + len(b) - n) >= 0.8 - 1e-12)


def test_repeats_are_judged_by_first_occurrences_too():
    line, tail = prose(1, 40), prose(2, 30)
    texts = [" ".join([line] * 9 + [tail]), " ".join([line] * 5 + [tail]), line + " " + prose(3, 30)]
    s = [neardup.shingles(hashes(t)).astype(np.uint32) for t in texts]
    assert not neardup.reaches(s[0], s[1]) and neardup.aligned(s[0], s[1]) and not neardup.aligned(s[0], s[2])
    assert [0, 1] in [sorted(p) for p in neardup.plausible(s).tolist()]


def test_the_bound_rules_out_no_similar_pair():
    r = random.Random(5)
    base = [np.array([r.getrandbits(32) for _ in range(60)], np.uint32) for _ in range(10)]
    s = [np.array([x for x in b if r.random() > 0.05], np.uint32) for b in base for _ in range(4)]
    kept = {tuple(p) for p in neardup.plausible(s).tolist()}
    similar = {(i, j) for i in range(len(s)) for j in range(i) if neardup.aligned(s[i], s[j])}
    assert similar <= kept and similar


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "new" + str(r.randint(0, 10**6))
    return " ".join(w)


def corpus():
    r, texts = random.Random(7), []
    passage = prose(999, 70)
    for g in range(25):
        base = prose(g, r.randint(80, 300))
        texts += [base] + [edited(base, r, r.randint(0, 4)) for _ in range(r.randint(0, 4))]
    big = prose(500, 250)
    texts += [edited(big, r, r.randint(0, 6)) for _ in range(80)] + [big] * 30  # a large group of near and exact copies
    texts += [passage + " " + prose(2000 + i, 60) for i in range(60)]  # a passage that many share
    texts += ["one two", "one  two", "one two three", "", None, "   "]
    return texts


def brute(texts, ids):
    s = [neardup.shingles(hashes(t)).astype(np.uint32) if t and len(hashes(t)) else None for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if s[i] is not None and s[j] is not None and neardup.aligned(s[i], s[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least[root(i)] = min(ids[i], least.get(root(i), ids[i]))
    return {ids[i]: least[root(i)] for i in range(len(texts)) if ids[i] is not None}


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    got = neardup.classes(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == brute(texts, ids)


def test_components(spark):
    r = random.Random(3)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    up = {v: v for p in links for v in p}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r_["node"]: r_["label"] for r_ in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {v: got.get(v, v) for v in up} == {v: root(v) for v in up}


def test_odd_documents(spark, odd_docs, no_docs):
    got = [(r["doc_id"], r["class_id"]) for r in neardup.classes(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    by = dict(got)
    assert by[1] == by[5] == 1 and by[2] == 2 and by[3] == 3 and by[6] == 6 and by[4] == 4 and by[None] is None
    kept = neardup.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 2**62 + 1]
    assert neardup.classes(no_docs).count() == 0 and neardup.one_of_each(no_docs).count() == 0


def test_a_null_id_joins_its_class(spark):
    t = prose(3, 50)
    df = spark.createDataFrame([(None, t), (9, t), (4, t + " more")], "doc_id long, text string")
    assert {r["class_id"] for r in neardup.classes(df).collect()} == {4}


def test_many_texts_under_one_id(spark):
    """Repeated and missing ids: links are found by text, and no row meets each other row of its id."""
    rows = [(i, t) for k in range(40) for t in (prose(k, 60), prose(k, 60) + " end") for i in (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"]) for r in neardup.classes(df).collect()} == {(7, 7), (None, 7)}
    none = df.filter("doc_id IS NULL")
    assert {r["class_id"] for r in neardup.classes(none).collect()} == {None} and neardup.one_of_each(none).count() == 40


def got_and_wanted(spark, texts):
    ids = list(range(len(texts)))
    got = neardup.classes(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"))
    return {r["doc_id"]: r["class_id"] for r in got.collect()}, brute(texts, ids)


def test_short_near_copies_meet(spark):
    """Few shingles: a word more at the end or the start, another first word."""
    texts = []
    for g in range(60):
        for n in (8, 9, 12, 13, 14, 17, 19):
            t = prose(1000 * n + g, n)
            texts += [t, t + " more", "other " + t.split(" ", 1)[1], "before " + t]
    got, want = got_and_wanted(spark, texts)
    assert got == want and sum(i != c for i, c in want.items()) > 1000


def test_similar_pairs_of_few_shingles_share_a_key():
    r, seen = random.Random(11), set()
    for _ in range(20_000):
        a = [r.getrandbits(64) for _ in range(r.randint(1, 18))]
        b = [x for x in a if r.random() > 0.1]
        for _ in range(r.randint(0, 3)):
            b.insert(r.randint(0, len(b)), r.getrandbits(64))
        if r.random() < 0.2 and len(b) > 1:
            k = r.randrange(len(b) - 1)
            b[k], b[k + 1] = b[k + 1], b[k]
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        if len(b) and min(len(a), len(b)) < 16 and neardup.reaches(a, b):
            seen.add((len(a), len(b)))
            x, y = (neardup.bucket_keys(s) for s in (a, b))
            assert len(np.intersect1d(x, y)) and len(x) <= 84 + 28 + neardup.BANDS
    assert {(4, 5), (5, 4), (12, 15), (15, 18), (15, 15)} <= seen


def test_unequally_repeated_copies_meet(spark):
    texts = []
    for g in range(12):
        t, line = prose(3000 + g, 60), prose(4000 + g, 12)
        texts += [t, t + " " + t, " ".join([t] * 3), " ".join([t] * 9) + " end"]
        texts += [" ".join([line] * n) for n in (1, 2, 10, 100)] + [prose(5000 + g, 5) + " tail", " ".join(["same"] * (g + 5))]
    got, want = got_and_wanted(spark, texts)
    assert got == want and sum(i != c for i, c in want.items()) > 70


def test_one_of_each_text_where_ids_repeat(spark):
    """Different texts under one id all stay; a text whose copy stays goes, whatever else its id has."""
    rows = [(7, t) for k in range(20) for t in (prose(k, 60), prose(k, 60) + " end")]
    rows += [(3, prose(100, 60)), (5, prose(100, 60) + " end"), (5, prose(101, 60)), (5, prose(101, 60)), (5, ""), (5, ""), (5, " "), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["class_id"], r["class_label"]) for r in neardup.classes(df).collect()]
    assert len(got) == len(rows)
    assert len({c for _, i, c in got if i == 7}) == 20 and {i for i, c, _ in got if c == 7} == {7}
    kept = sorted((r["doc_id"], r["text"]) for r in neardup.one_of_each(df).collect())
    assert [t for i, t in kept if i == 3] == [prose(100, 60)]
    assert [t for i, t in kept if i == 5] == sorted(["", " ", prose(101, 60)]) and [t for i, t in kept if i == 8] == [""]
    sevens = [t for i, t in kept if i == 7]
    assert len(sevens) == 20 and {t.removesuffix(" end") for t in sevens} == {prose(k, 60) for k in range(20)}


def test_rows_without_an_id_are_of_their_class(spark):
    """Equal rows without an id leave one; a copy of a text that has an id goes; unrelated texts of one id, or of none, stay."""
    a, b, c, d = (prose(k, 50) for k in (1, 2, 3, 4))
    rows = [(7, a, 1), (7, b, 1), (9, c, 1), (3, a + " end", 1), (None, d, 1), *[(None, d, 1)] * 4, (None, b, 1), (None, None, 1), (None, None, 1), (2, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.one_of_each(df).collect()), key=str)
    assert got == sorted([(7, b), (9, c), (3, a + " end"), (None, d), (None, None), (2, None)], key=str)
    labels = [r["class_label"] for r in neardup.classes(df).collect()]
    assert len(labels) == len(rows) and len(set(labels)) == 6
