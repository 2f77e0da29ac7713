import heapq
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skylattice.llm import tokenbin
from skylattice.llm.common import staged

PATH = public_tokenizers.path("word_bpe_49k.json")


def huffman_cost(counts):
    h = [c for c in counts if c]
    if len(h) == 1:
        return h[0]
    heapq.heapify(h)
    total = 0
    while len(h) > 1:
        a = heapq.heappop(h) + heapq.heappop(h)
        total += a
        heapq.heappush(h, a)
    return total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=60), st.integers(6, 16))
def test_lengths_are_optimal_and_limited(counts, limit):
    c = np.array(counts)
    n = tokenbin.code_lengths(c, limit)
    assert ((n > 0) == (c > 0)).all() and (n <= limit).all()
    used = n[n > 0].astype(float)
    assert (2.0**-used).sum() <= 1
    cost = int((c * n).sum())
    assert cost >= huffman_cost(counts)
    if tokenbin.code_lengths(c, 16).max(initial=0) <= limit:
        assert cost == int((c * tokenbin.code_lengths(c, 16)).sum())
    if limit == 16 and len(used) < 16:
        assert cost == huffman_cost(counts)


def test_too_many_symbols():
    with pytest.raises(ValueError):
        tokenbin.code_lengths(np.ones(20, int), 4)
    assert tokenbin.code_lengths(np.ones(16, int), 4).tolist() == [4] * 16
    assert not tokenbin.code_lengths(np.zeros(5, int)).any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 299), max_size=50), max_size=12), st.integers(1, 16), st.integers(0, 9))
def test_files_round_trip(docs, block, skew):
    ids = [np.array(d, np.int64) // (1 + skew) for d in docs]
    flat = np.concatenate([*ids, np.empty(0, np.int64)])
    n = tokenbin.code_lengths(np.bincount(flat, minlength=300), 12)
    names = [None if i % 3 == 0 else i * 10**12 for i in range(len(ids))]
    data = tokenbin.encode_file(names, ids, n, 12, block)
    got_names, got = tokenbin.decode_file(data)
    assert got_names == names and all(np.array_equal(a, b) for a, b in zip(ids, got, strict=True))
    with pytest.raises(ValueError):
        tokenbin.decode_file(b"x" * len(data))


def test_odd_documents(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(tokenbin, "FILE_IDS", 50)
    got = tokenbin.read_files(tokenbin.write_files(staged(tokenbin.tokenized(odd_docs, PATH)))).toPandas().sort_values("start")
    coder = Tokenizer.from_file(PATH)
    docs = [(d, np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for d, t in odd_docs.select("doc_id", "text").collect()]
    docs.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    n = np.array([len(x) for _, x in docs])
    assert got["n_tokens"].tolist() == n.tolist() and got["start"].tolist() == (np.cumsum(n) - n).tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(x.tobytes()) for _, x in docs]
    again = tokenbin.read_files(tokenbin.write_files(staged(tokenbin.tokenized(odd_docs, PATH)))).orderBy("start").collect()
    assert [r["doc_id"] for r in again] == [d for d, _ in docs]
    assert tokenbin.read_files(tokenbin.write_files(staged(tokenbin.tokenized(no_docs, PATH)))).count() == 0


def test_ids_before_each_file(spark, monkeypatch):
    monkeypatch.setattr(tokenbin, "GROUP", 3)
    rows = [(p, s, (p * 7 + s * 3) % 11 + 1) for p in range(20) if p != 4 for s in range(p % 4 + 1)]
    got = {(r["part"], r["seq"]): r["base"] for r in tokenbin.before_each(spark.createDataFrame(rows, "part int, seq int, n_ids long")).collect()}
    assert got == {(p, s): sum(n for q, t, n in rows if (q, t) < (p, s)) for p, s, _ in rows}


def test_wide_vocabularies_are_refused(spark):
    with pytest.raises(Exception, match="16 bits"):
        tokenbin.tokenized(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH, end_id=70_000).collect()
