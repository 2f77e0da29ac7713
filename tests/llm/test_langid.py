import random

import numpy as np

from skylattice.llm import langid
from skylattice.llm.common import held_out
from tests.llm.conftest import prose

ALPHABETS = {"aa": "etaoinshr", "bb": "éàçuilmpq", "cc": "üößwkzgvb"}


def corpus(spark, n=60):
    rows = [(i, prose(i, random.Random(i).randint(5, 80), ALPHABETS[lang]), lang) for i, lang in enumerate(sorted(ALPHABETS) * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    docs = corpus(spark)
    got = langid.identify(docs, langid.train(docs)).join(docs, "doc_id").withColumn("out", held_out(F.col("doc_id"))).toPandas()
    out = got[got["out"]]
    assert len(out) > 10 and (out["lang"] == out["lang_pred"]).all() and got["score"].between(0, 1).all()


def test_codewords():
    for n in (1, 2, 3, 4, 6, 7, 20):
        c = langid.codewords(n)
        assert len(c) == n and len({tuple(r) for r in c}) == n
        if n > 2:
            d = np.array([(a != b).sum() for a in c for b in c]).reshape(n, n) + np.eye(n) * 99
            assert d.min() >= (3 if n > 3 else 2)
    assert langid.codewords(4).shape == (4, 7)


def test_a_wrong_bit_is_corrected():
    code = langid.codewords(4)
    m = langid.Model(["a", "b", "c", "d"], code, np.vstack([code, np.zeros((1, 7))]).astype(np.float32) * 4, np.ones(7, np.float32))
    x = np.eye(4, dtype=np.float32)
    assert m.predict(x)[0].tolist() == [0, 1, 2, 3]
    m.weights[1, 3] *= -1
    assert m.predict(x)[0].tolist() == [0, 1, 2, 3]
    m.weights[1, 3] *= -1
    assert not m.predict(x)[2].any() and m.predict(np.array([[0.5, 0.5, 0, 0]], np.float32))[2].all()


def test_odd_documents(spark, odd_docs, no_docs):
    m = langid.train(corpus(spark))
    rows = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(odd_docs, m).collect()]
    assert len(rows) == odd_docs.count()
    assert all(p == "und" and s == 0 for d, p, s in rows if d in (2, 3, 6)) and all(p == "aa" for d, p, _ in rows if d in (1, 4, None))
    assert langid.identify(no_docs, m).count() == 0 and langid.train(no_docs) is None
    assert {r["lang_pred"] for r in langid.identify(odd_docs, None).collect()} == {"und"}
    one = corpus(spark).filter("lang = 'bb'")
    assert {r["lang_pred"] for r in langid.identify(one, langid.train(one)).collect()} == {"bb"}


def test_lang_of_scored_documents_is_not_read(spark):
    docs = corpus(spark)
    m = langid.train(docs)
    assert sorted(map(tuple, langid.identify(docs, m).collect())) == sorted(map(tuple, langid.identify(docs.drop("lang"), m).collect()))


def plain_features(text):
    """n-grams of 1 to 3 letters one by one; what isn't a letter is 0, and of a run of those only the first after a letter stays."""
    shown = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    shown = [0, *(x for i, x in enumerate(shown) if x or (i and shown[i - 1])), 0]
    out = np.zeros(langid.FEATURES)
    for n in (1, 2, 3):
        for i in range(len(shown) - n + 1):
            h = shown[i]
            for c, odd in zip(shown[i + 1 : i + n], (0x9E3779B1, 0x85EBCA77), strict=False):
                h = (h * odd + c) % 2**32
            out[(h * 0xC2B2AE3D % 2**32) * langid.FEATURES // 2**32] += 1
    out = np.sqrt(out)
    return out / np.sqrt((out**2).sum())


def test_features_equal_plain_ones():
    for text in ("a", "Ab, c", "ünd 12 über!!", prose(1, 50), "  x  "):
        assert np.allclose(langid.features(text), plain_features(text), atol=1e-6)
    assert langid.features("12 !") is None


def test_decoding_and_gradient_equal_plain_ones(spark):
    docs = corpus(spark, 10).toPandas()
    x = np.stack([langid.features(t) for t in docs["text"]])
    m = langid.fit(x, list(docs["lang"]), steps=30)
    best, score, unsure = m.predict(x)
    for i, row in enumerate(x.astype(np.float64)):
        margin = [row @ m.weights[:-1, b] + m.weights[-1, b] for b in range(m.code.shape[1])]
        d = [np.mean([m.trust[b] * np.log1p(np.exp(-margin[b] * m.code[k, b])) for b in range(len(margin))]) for k in range(3)]
        p = np.exp(-len(margin) * (np.array(d) - min(d)))
        assert int(np.argmin(d)) == best[i] and abs(p[best[i]] / p.sum() - score[i]) < 1e-3 and unsure[i] == (score[i] < langid.AMBIGUOUS)
    # the first step goes against the sign of each weight's slope, taken by differences
    one, y = langid.fit(x, list(docs["lang"]), steps=1), langid.codewords(3)[[sorted(ALPHABETS).index(v) for v in docs["lang"]]]
    for f, b in [(int(np.argmax(x[0])), 0), (int(np.argmax(x[25])), 1), (int(np.argmax(x[15])), 2)]:
        loss = lambda w: np.log1p(np.exp(-y[:, b] * x[:, f] * w)).mean()  # noqa: E731, B023
        slope = (loss(1e-3) - loss(-1e-3)) / 2e-3
        assert abs(slope) < 1e-9 or np.sign(one.weights[f, b]) == -np.sign(slope)


def test_a_sample_of_a_hot_language_is_the_least_hashed_ids(spark):
    """The threshold on hashes takes the same ids as ranking all would, also where one id is on most rows."""
    from pyspark.sql import functions as F

    known = spark.range(9000).selectExpr("id as doc_id", "'word' as text", "if(id % 50 = 0, 'bb', 'aa') as lang").unionAll(spark.range(5000).selectExpr("7L", "'hot'", "'aa'"))
    seen = []
    fit, langid.fit = langid.fit, lambda x, lang: seen.append(len(lang)) or None
    try:
        langid.train(known)
    finally:
        langid.fit = fit
    inside = known.filter(~held_out(F.col("doc_id")))
    n = {r["lang"]: r["n"] for r in inside.groupBy("lang").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert seen[0] in {min(400, n["aa"]) + n["bb"] - i for i in (0, 1)}  # the hot id isn't learnt from


def test_no_language_is_left_out(spark):
    """300 languages, each of one word of its own: all can be predicted, and are where the document is one that was learnt from."""
    rows = [(k * 8 + i, f"{prose(k, 1, 'abcdefghijklmnopqrstuvwxyz')} {prose(k + 1000, 1, 'abcdefghijklmnopqrstuvwxyz')} " * 3, f"l{k:03}") for k in range(300) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(docs)
    assert len(m.langs) == 300
    got = langid.identify(docs, m).join(docs, "doc_id").toPandas()
    assert got["lang_pred"].nunique() > 290 and (got["lang"] == got["lang_pred"]).mean() > 0.95


def test_scores_tell_of_mixed_texts(spark):
    """Texts half in one language and half in another score lower than whole ones, and some are flagged."""
    m = langid.train(corpus(spark))
    whole = spark.createDataFrame([(i, prose(900 + i, 60, ALPHABETS["aa"])) for i in range(40)], "doc_id long, text string")
    mixed = spark.createDataFrame([(i, prose(900 + i, 30, ALPHABETS["aa"]) + " " + prose(950 + i, 30, ALPHABETS["bb"])) for i in range(40)], "doc_id long, text string")
    a, b = (langid.identify(d, m).toPandas() for d in (whole, mixed))
    assert a["score"].min() > b["score"].median() and b["ambiguous"].any() and not a["ambiguous"].any()


def test_ties_go_to_the_first_language():
    m = langid.Model(["a", "b"], langid.codewords(2), np.zeros((2, 1), np.float32), np.ones(1, np.float32))
    best, score, unsure = m.predict(np.ones((1, 1), np.float32))
    assert best[0] == 0 and abs(score[0] - 0.5) < 1e-6 and unsure[0]
