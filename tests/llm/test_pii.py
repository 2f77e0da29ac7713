import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import pii
from tests.compare import SMALL

# The base patterns as told (fixed values); the module finds the same matches in linear time.
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else False, k == 2 and 13 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+() 0123456789é%\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_linear_on_long_runs():
    for text in ("a" * 300_000 + "@", "1" * 100_000, "+1" + "(" * 100_000, "1." * 50_000, "a@" * 50_000):
        pii.base_spans(text)


def test_gradients():
    n = pii.Network.new()
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    x, y = pii.generated(6)
    y = y.astype(np.int64)
    _, g = n.loss_and_gradient(x, y)
    rng = np.random.default_rng(0)
    for k, w in n.p.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        was = w[at]
        w[at] = was + 1e-3
        up = n.loss_and_gradient(x, y)[0]
        w[at] = was - 1e-3
        down = n.loss_and_gradient(x, y)[0]
        w[at] = was
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-2 * max(1, abs(g[k][at]))


def test_best_path_is_the_best():
    n = pii.Network.new()
    rng = np.random.default_rng(1)
    n.p["step"], n.p["first"] = rng.normal(size=(9, 9)), rng.normal(size=9)
    e = rng.normal(size=(4, 9))
    score = lambda p: n.p["first"][p[0]] + sum(e[i, t] for i, t in enumerate(p)) + sum(n.p["step"][a, b] for a, b in zip(p, p[1:], strict=False))
    best = max(score(p) for p in np.ndindex(9, 9, 9, 9))
    assert np.isclose(score(n.decode(e)), best)


def test_posterior_sums_all_paths():
    n = pii.Network.new()
    rng = np.random.default_rng(2)
    n.p["step"], n.p["first"] = rng.normal(size=(9, 9)), rng.normal(size=9)
    e = rng.normal(size=(4, 9))
    want = np.zeros((4, 9))
    for p in np.ndindex(9, 9, 9, 9):
        w = np.exp(n.p["first"][p[0]] + sum(e[i, t] for i, t in enumerate(p)) + sum(n.p["step"][a, b] for a, b in zip(p, p[1:], strict=False)))
        want[np.arange(4), p] += w
    assert np.allclose(n.posterior(e), want / want[0].sum())


@pytest.fixture(scope="module")
def net(spark, odd_docs):
    return pii.train(odd_docs)


def test_held_out_windows(net):
    x, y = pii.generated(300, seed=1234)
    e = net.emit(x)
    right = np.mean([(net.decode(e[i]) == y[i]).mean() for i in range(len(x))])
    assert right > 0.98


def test_added_spans_are_valid_and_apart(net):
    texts = ["call (415) 555-0134 today, ", "nothing here at all", "on 2024-01-02 at 10:30 we paid 12.50", "x@y.co " * 3]
    for text, (base, more) in zip(texts, pii.find(net, texts), strict=True):
        assert base == plain(text)
        for k, s, e in more:
            assert pii.valid(k, text[s:e]) and not any(a < e and s < b for _, a, b in base)
    assert pii.find(net, texts)[1] == ([], []) and pii.find(net, texts)[2] == ([], [])


def test_planted_forms_that_the_patterns_miss(spark, net):
    """Numbers side by side, whose match fails as a whole, and national phone numbers, in whole real texts: most are found, little else is."""
    r = random.Random(5)
    texts = [t for (t,) in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect() if t]
    digits = lambda k: "".join(str(r.randrange(10)) for _ in range(k))

    def card():
        body = str(r.randint(3, 6)) + digits(14)
        return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))

    forms = (lambda: [f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", card()], lambda: [card(), f"({digits(3)}) {digits(3)}-{digits(4)}"], lambda: [f"{digits(3)}-{digits(3)}-{digits(4)}"], lambda: [f"+44 {digits(3)} {digits(7)}", card()])
    planted = []
    for i in range(400):
        text, parts = texts[i % len(texts)], forms[i % 4]()
        at = r.randrange(len(text) + 1)
        at = next((k for k in range(at, len(text)) if text[k].isspace()), len(text))
        starts = [at + 1, at + 2 + len(parts[0])]
        spans = {(s, s + len(one)) for s, one in zip(starts, parts, strict=False)}
        planted.append((text[:at] + " " + " ".join(parts) + " " + text[at:], spans))
    missed = hits = added = wrong = 0
    for (_, spans), (base, more) in zip(planted, pii.find(net, [t for t, _ in planted]), strict=True):
        due, have = spans - {(s, e) for _, s, e in base}, {(s, e) for _, s, e in more}
        missed, hits, added, wrong = missed + len(due), hits + len(due & have), added + len(have), wrong + len(have - spans)
    assert missed > 500 and hits / missed > 0.8 and 1 - wrong / added >= 0.95


def test_long_stretch_is_decoded_whole(net):
    text = "1 " * 3000 + "me@mail.example.com"
    base, more = pii.find(net, [text])[0]
    assert (0, 6000, 6019) in base


def test_odd_documents(spark, odd_docs, no_docs, net):
    got = {(r["doc_id"], r["base_sha256"]): r for r in pii.search(odd_docs, net).collect()}
    for doc, text in odd_docs.select("doc_id", "text").collect():
        base = plain(text or "")
        r = got[doc, hashlib.sha256(pii.told(base).encode()).hexdigest()]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == i for k, _, _ in base) for i in range(4))
        assert set(pii.told(base).split(",")) <= set(r["spans"].split(","))
        assert r["n_spans"] == len([x for x in r["spans"].split(",") if x])
    assert pii.search(no_docs, pii.train(no_docs)).count() == 0


def test_redaction(spark, odd_docs, net):
    out = pii.redact(odd_docs, net)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    r = out.filter("doc_id = 8").head()
    assert r["text"] == "mail [EMAIL] or call [PHONE], 10.0.0.256 [IP], [CARD]" and r["n_chars"] == len(r["text"])
    assert out.filter("doc_id = 2").head()["text"] is None
    assert pii.redacted("abcdef", [(0, 1, 3), (3, 2, 5)]) == "a[EMAIL]f"


def test_numbers_made_of_the_same_digits_side_by_side(net):
    """The same card twice in a row, written together, in groups or with hyphens: two spans each."""
    for one in ("4111 1111 1111 1111", "4111-1111-1111-1111", "5500 0000 0000 0004"):
        text = f"pay {one} {one} now, word word"
        base, more = pii.find(net, [text])[0]
        assert sorted(base + more, key=lambda x: x[1]) == [(2, 4, 4 + len(one)), (2, 5 + len(one), 5 + 2 * len(one))]


def test_parts_of_a_run_of_digits():
    a, b = "4111 1111 1111 1111", "378282246310005"
    text = f"x {a} {b} {a} y"
    assert [text[s:e] for s, e in pii.parted(2, text, 2, len(text) - 2)] == [a, b, a]
    assert pii.parted(2, "4111 1111 1111 1112 " + a, 0, 39) == [] and pii.parted(2, a, 0, 19) == [(0, 19)] and pii.parted(3, "1 2 3", 0, 5) == []


def test_training_is_the_same_for_any_order_of_sums(monkeypatch):
    """Weights are trained in double precision and rounded, so another order of adding up, as on another machine, gives the same digests."""
    x, y = pii.generated(96)
    y = y.astype(np.int64)
    monkeypatch.setattr(pii, "PASSES", 2)
    digest = lambda n: {k: hashlib.sha256(w.tobytes()).hexdigest() for k, w in n.p.items()}
    first = digest(pii.Network.new().fit(x, y))
    real = pii.Network.loss_and_gradient

    def stirred(self, a, b):
        loss, g = real(self, a[::-1], b[::-1])
        return loss, {k: w * (1 + 2e-16 * np.random.default_rng(int(abs(loss) * 1e6)).normal(size=w.shape)) for k, w in g.items()}

    monkeypatch.setattr(pii.Network, "loss_and_gradient", stirred)
    assert digest(pii.Network.new().fit(x, y)) == first
