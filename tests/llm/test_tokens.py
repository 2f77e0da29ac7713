import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm.tokens import ByteLevel, WordLevel, agrees

CODERS = {k: c(public_tokenizers.path(f)) for k, c, f in (("byte", ByteLevel, "byte_bpe_50k.json"), ("word", WordLevel, "word_bpe_49k.json"))}
ODD = ["", " ", "  a  b \n c", "a\x1c b  c  ", "<|endoftext|> a<|endoftext|> <|startoftext|>x", " lead", "trail ", "don't 'll  x\t y", "é ́a", "　x y", "a\x85 b", "A ŉ İ ſ", "ßÀÉ×÷²½12 34a5 _a_b\xa0c \xad", "日本語 texte", "\U0001f600 x", "ÿŸ Ǆ", "a\r\nb\x0bc\x0cd", "x" * 5000]


def check(coder, text):
    want = coder.library.encode(text, add_special_tokens=False).ids
    assert coder.ids(text).tolist() == want


@pytest.mark.parametrize("kind", sorted(CODERS))
@pytest.mark.parametrize("text", ODD)
def test_odd_texts(kind, text):
    check(CODERS[kind], text)
    assert len(CODERS[kind].ids(None)) == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x250), max_size=60))
def test_equal_to_the_library(text):
    for c in CODERS.values():
        check(c, text)


def test_whole_sample(spark):
    import duckdb

    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for c in CODERS.values():
        for t in texts:
            assert np.array_equal(c.ids(t), np.array(c.library.encode(t, add_special_tokens=False).ids, np.uint32))


def test_vocabularies_on_which_the_engines_might_differ_are_told():
    assert all(c.ok for c in CODERS.values())
    letters = {"a": 0, "b": 1, "c": 2}
    assert agrees({**letters, "ab": 3, "abc": 4}, [("a", "b"), ("ab", "c")])
    assert not agrees({**letters, "ab": 4, "bc": 3, "abc": 5}, [("a", "b"), ("b", "c"), ("ab", "c")])  # ids don't rise
    assert not agrees({**letters, "ab": 3, "bc": 4, "abc": 5}, [("a", "b"), ("b", "c"), ("a", "bc")])  # a b c goes to ab c, whose joining is a token
