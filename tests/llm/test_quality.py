import re

import numpy as np

from skylattice.llm import quality
from tests.llm.conftest import prose


def corpus(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        t = prose(i, 40)
        if bad:
            t = " ".join(w.upper() + "!!" for w in t.split()) if i % 8 else " ".join(w for w in t.split()[:8] for _ in range(5))
        rows.append((i, t))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    m = quality.train(docs, labels)
    got = quality.score(docs, m).join(labels, "doc_id").toPandas()
    assert ((got["score"] >= quality.THRESHOLD) == (got["quality"] == 1)).mean() > 0.97 and got["score"].between(0, 1).all()


def test_features_are_those_of_the_words():
    a, b = quality.feature_rows("ab  abc\n"), quality.feature_rows(" ab abc")
    assert a.tolist() == b.tolist() and len(a) == 2 + (2 + 3) + (1 + 2)
    assert quality.REPEAT_ROW in quality.feature_rows("x x") and not len(quality.feature_rows(" \n"))


def test_score_is_the_softmax_of_the_average(monkeypatch):
    """Against plain code: every vector kept, gradients of the loss by differences, one softmax a text."""
    monkeypatch.setattr(quality, "PASSES", 1)
    rng = np.random.default_rng(0)
    texts = [prose(i, 12) + (" bad bad" if i % 2 else " fine words") for i in range(24)]
    both = [np.unique(quality.feature_rows(t), return_counts=True) for t in texts]
    label = np.arange(24) % 2
    m = quality.fit([r for r, _ in both], [c for _, c in both], label, seed=11, rate=1.0)
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / quality.WIDTH, 1 / quality.WIDTH, (quality.REPEAT_ROW + 1, quality.WIDTH)).astype(np.float32).astype(np.float64)
    layer, offset = np.zeros((quality.WIDTH, 2)), np.zeros(2)

    def share(hidden, layer, offset):
        z = np.exp(hidden @ layer + offset)
        return z / z.sum()

    for step, i in enumerate(rng.permutation(24)):
        lr, mean = 1 - step / 24, np.mean([vectors[r] for r in quality.feature_rows(texts[i])], axis=0)
        loss = lambda h, w, o: -np.log(share(h, w, o)[label[i]])  # noqa: E731, B023
        slope = lambda at, f: np.array([(f(at + d) - f(at - d)) / 2e-5 for d in 1e-5 * np.eye(at.size).reshape(-1, *at.shape)]).reshape(at.shape)
        back, to_layer, to_offset = slope(mean, lambda h: loss(h, layer, offset)), slope(layer, lambda w: loss(mean, w, offset)), slope(offset, lambda o: loss(mean, layer, o))
        rows, counts = both[i]
        for r, c in zip(rows, counts, strict=True):
            vectors[r] -= lr * len(rows) ** 0.5 * c / counts.sum() * back
        layer, offset = layer - lr * to_layer, offset - 0.1 * lr * to_offset
    for t in [*texts, prose(99, 30)]:
        assert abs(m.score(t) - share(np.mean([vectors[r] for r in quality.feature_rows(t)], axis=0), layer, offset)[1]) < 1e-4
    assert abs(m.score("") - share(np.zeros(quality.WIDTH), layer, offset)[1]) < 1e-5


def test_feature_rows_equal_plain_ones():
    """Words and n-grams one by one: features are equal where the text's pieces are, and as many."""
    for text in ("ab  abc\n abc", "x", " ünd über\tünd ünd ", "a" * 40 + " b"):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        padded = b" " + b" ".join(words) + b" "
        grams = [padded[i : i + n] for n in (3, 4) for i in range(len(padded) - n + 1) if b" " not in padded[i + 1 : i + n - 1]]
        want = [("w", w) for w in words] + [("again", b"")] * sum(a == b for a, b in zip(words, words[1:], strict=False)) + [("g", g) for g in grams]
        got = quality.feature_rows(text).tolist()
        assert len(got) == len(want)
        by = {}
        for row, piece in zip(got, want, strict=True):
            assert by.setdefault(piece, row) == row and (piece[0] == "again") == (row == quality.REPEAT_ROW) and (piece[0] == "w") == (row < quality.WORD_ROWS)
        assert len(set(by.values())) == len(by)


def test_clashing_columns(spark):
    docs, labels = corpus(spark, 40)
    odd = labels.selectExpr("doc_id", "quality", "doc_id + 1 as _label", "'x' as text", "1 as label", "2 as toxic")
    assert np.array_equal(quality.train(docs.selectExpr("*", "3 as quality", "4 as _label"), odd).difference, quality.train(docs, labels).difference)


def test_odd_documents(spark, odd_docs, no_docs):
    docs, labels = corpus(spark)
    m = quality.train(docs, labels)
    got = {r["doc_id"]: r["_q"] for r in quality.score(odd_docs, m, "_q").collect()}
    assert got[2] == got[3] and all(0 <= v <= 1 for v in got.values())
    kept = quality.keep(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    empty = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    assert quality.keep(odd_docs, empty).count() == odd_docs.count()  # nothing learnt: every score is 0.5
    assert quality.keep(no_docs, labels).count() == 0


def test_an_id_on_very_many_rows_is_not_learnt_from(spark):
    docs, labels = corpus(spark)
    from skylattice.llm.common import MOST_COPIES, seldom

    many = docs.unionAll(spark.range(500).selectExpr("9999L as doc_id", "'x' as text"))
    ids = spark.createDataFrame([(9999,), (1,), (77777,)], "doc_id long")
    assert [r["doc_id"] for r in seldom(many, ids).collect()] == [1] and MOST_COPIES < 500
    quality.train(many, labels.unionAll(spark.createDataFrame([(9999, 1)], labels.schema)))
