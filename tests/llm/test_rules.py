import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import rules
from tests.llm.conftest import prose


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = {k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet="ab \n\t#é|\x0b\x1c", max_size=120), st.lists(st.sampled_from(["a b c d e f g h", "x", "\n"]), max_size=12).map(" ".join)))
def test_base_counts(text):
    assert rules.base_counts(text)[0] == plain(text)


def test_distance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.25, 0.25, 0.5]])
    d = rules.distance(p, q)
    m = (p + q[2]) / 2
    want = np.sqrt(sum(a * np.log2(a / b) for a, b in zip(p, m, strict=True) if a) / 2 + sum(a * np.log2(a / b) for a, b in zip(q[2], m, strict=True) if a) / 2)
    assert np.allclose(d, [0, 1, want])


def corpus(spark):
    common = "the of and to".split()
    docs = []
    for i in range(40):
        w = prose(i, 200).split()
        docs.append((i, " ".join(common[k // 3 % 4] if k % 3 else x for k, x in enumerate(w)), "en"))
    docs += [(100, " | ".join(prose(100, 200).split()), None), (101, " ".join(x.upper() + "!!" for x in prose(101, 200).split()), None), (102, docs[3][1], None), (103, "too short", "en")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string")


def test_references_equal_plain_counts(spark):
    docs = corpus(spark)
    ref = rules.references(docs)
    words = [w for r in docs.filter("lang = 'en'").collect() for w in r["text"].split()]
    n = Counter(words)
    common = {w: c for w, c in n.items() if c >= rules.COMMON * len(words)}
    assert len(ref.words) == len(common) and {"the", "of", "and", "to"} <= set(common)
    assert np.allclose(np.sort(ref.shares[0, :-1]), np.sort([c / len(words) for c in common.values()]))
    assert np.isclose(ref.shares.sum(), 1) and np.isclose(ref.classes.sum(), 1)


def test_verdicts(spark):
    docs = corpus(spark)
    got = {r["doc_id"]: r for r in rules.judge(docs, rules.references(docs)).collect()}
    assert all(got[i]["kept"] for i in range(40)) and got[102]["kept"]
    assert not got[100]["kept"] and not got[101]["kept"] and not got[100]["base_failed"] and got[103]["base_failed"] and not got[103]["kept"]


def test_odd_documents(spark, odd_docs, no_docs):
    ref = rules.references(odd_docs)
    rows = rules.judge(odd_docs, ref).collect()
    texts = {}
    for doc, text in odd_docs.select("doc_id", "text").collect():
        texts[doc] = text
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and (not r["base_failed"] or not r["kept"])
    assert len(rows) == odd_docs.count()
    assert rules.references(no_docs) is None and rules.judge(no_docs, None).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in rules.judge(odd_docs, None).collect())
