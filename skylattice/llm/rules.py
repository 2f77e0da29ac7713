"""Quality rules: fixed counts, then divergence from language references.

The references are made from all documents with a known language: for each language, the shares of character classes and the
shares of its common words (those that make up COMMON of its words at least). A document is compared with every language by
the Jensen-Shannon distance of both histograms; the nearest language decides. Texts under the guards' lengths aren't judged by
that histogram, as short texts diverge by chance.

Common words are found exactly in two passes with bounded memory: words are counted in hash buckets, and only words in
buckets that hold COMMON of a language's words are counted each.

Defined cases. Columns besides doc_id, text and those named here, whatever their names, aren't read. Null text: no words, so base_failed. Null lang: left out of the references, judged all the same. No language at
all: the verdict is that of the base rules. Null doc_id: kept. Repeated rows: each is judged. An empty table gives an
empty result. Texts are read whole; memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_document
from .hashing import IS_SPACE, as_bytes, windows, word_bounds, word_hashes

COMMON, BUCKETS = 0.004, 4096
#: Least bytes for the class histogram, least words for the word histogram, largest distances.
MIN_CHARS, MIN_WORDS = 400, 50
MAX_CLASS, MAX_WORD = 0.29, 0.47
SYMBOLS = "#*$%&|<>"
#: Classes of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 sentence marks, 6 symbols, 7 beyond ASCII.
N_CLASSES = 8
CLASS = np.zeros(256, np.int64)
for _k, _s in ((1, "abcdefghijklmnopqrstuvwxyz"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, "0123456789"), (5, ".,;:!?'\"()-"), (6, SYMBOLS)):
    CLASS[list(_s.encode())] = _k
CLASS[IS_SPACE] = 4
CLASS[128:] = 7


@dataclass
class References:
    """By language: class shares, and shares of the common words (last: all other words). words: sorted hashes."""

    classes: np.ndarray
    words: np.ndarray
    shares: np.ndarray


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence to base 2) of p from each row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def base_counts(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the words' hashes, the text's bytes."""
    x = as_bytes(text)
    starts, ends = word_bounds(x)
    h = word_hashes(x, starts, ends)
    chars = int((((x & 0xC0) != 0x80) & ~IS_SPACE[x]).sum())
    symbols = sum(text.count(c) for c in SYMBOLS) if text else 0
    lines = [v for v in (text or "").split("\n") if v.strip(" \t\n\r\x0b\x0c")]
    repeated = 0
    w = windows(h, 8)
    if len(w) > 1:
        order = np.sort(w)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            hit = np.flatnonzero(np.isin(w, twice))
            covered = np.zeros(len(h) + 1, np.int64)
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + 8, -1)
            repeated = int((np.cumsum(covered)[:-1] > 0).sum())
    return (len(h), chars, symbols, len(lines) - len(set(lines)), repeated), h, x


def references(docs: DataFrame) -> References | None:
    known = docs.filter(F.col("lang").isNotNull()).select("lang", "text")

    def bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                x = as_bytes(text)
                h = word_hashes(x, *word_bounds(x))
                t = total.setdefault(lang, np.zeros(N_CLASSES + BUCKETS, np.int64))
                t[:N_CLASSES] += np.bincount(CLASS[x], minlength=N_CLASSES)
                t[N_CLASSES:] += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        for lang, t in total.items():
            used = np.flatnonzero(t)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": t[used]})

    buckets: dict[str, np.ndarray] = {}
    for r in known.mapInPandas(bucket, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # at most N_CLASSES + BUCKETS rows a language
        buckets.setdefault(r["lang"], np.zeros(N_CLASSES + BUCKETS, np.int64))[r["bucket"]] = r["n"]
    if not buckets:
        return None
    langs = sorted(buckets)
    words = {v: max(int(buckets[v][N_CLASSES:].sum()), 1) for v in langs}
    heavy = {v: buckets[v][N_CLASSES:] >= COMMON * words[v] for v in langs}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                found = []
                for text in texts:
                    x = as_bytes(text)
                    h = word_hashes(x, *word_bounds(x))
                    found.append(h[heavy[lang][(h & np.uint64(BUCKETS - 1)).astype(np.int64)]])
                word, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"lang": lang, "word": word.view(np.int64), "n": n})

    least = F.create_map(*[F.lit(y) for v in langs for y in (v, COMMON * words[v])])
    common = known.mapInPandas(each, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least[F.col("lang")]).collect()  # at most 1 / COMMON rows a language
    listed = np.unique(np.array([r["word"] for r in common], np.int64).view(np.uint64))
    shares = np.zeros((len(langs), len(listed) + 1))
    for r in common:
        at = np.searchsorted(listed, np.array([r["word"]], np.int64).view(np.uint64)[0])
        shares[langs.index(r["lang"]), at] = r["n"] / words[r["lang"]]
    shares[:, -1] = 1 - shares.sum(axis=1)
    classes = np.stack([buckets[v][:N_CLASSES] / max(int(buckets[v][:N_CLASSES].sum()), 1) for v in langs])
    return References(classes, listed, shares)


def divergence(h: np.ndarray, x: np.ndarray, ref: References) -> tuple[float, float]:
    """Distances from the nearest language; 0 where a guard applies or there is nothing to compare with."""
    by_class, by_word = np.zeros(len(ref.classes)), np.zeros(len(ref.classes))
    if len(x) >= MIN_CHARS:
        by_class = distance(np.bincount(CLASS[x], minlength=N_CLASSES) / len(x), ref.classes)
    if len(h) >= MIN_WORDS and len(ref.words):
        at = np.minimum(np.searchsorted(ref.words, h), len(ref.words) - 1)
        at = np.where(ref.words[at] == h, at, len(ref.words))
        by_word = distance(np.bincount(at, minlength=len(ref.words) + 1) / len(h), ref.shares)
    best = int(np.argmin(by_class / MAX_CLASS + by_word / MAX_WORD))
    return float(by_class[best]), float(by_word[best])


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge(docs: DataFrame, ref: References | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                counts, h, x = base_counts(text)
                failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
                c, w = divergence(h, x, ref) if ref is not None else (0.0, 0.0)
                rows.append((doc, *counts, failed, not failed and c <= MAX_CLASS and w <= MAX_WORD, c, w))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in RESULT.split(", ")])

    return by_document(docs, run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return judge(docs, references(docs))
