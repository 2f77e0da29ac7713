"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier on hashed character n-grams predicts each bit. A text's bits are
decoded to the language with the least loss, each bit weighing as its classifier does on the texts it learnt from. A small
lead over the second language is flagged as ambiguous. Scores are softened by a temperature, so that over the sample their mean is the share
that the model gets right, with one wrong text added.

Defined cases. Ties: of languages at equal distance the first by name is predicted (and the score tells of the tie). Columns besides doc_id, text and lang, whatever their names, aren't read. Null text, or text without a letter: `und`, score 0, not ambiguous. No labelled document at all: every text is
`und`, score 0. A single language: it is always predicted, with the score of its one bit. Null lang: never learnt from.
Null doc_id: in the held-out fold (crc32 of the empty text is 0). Repeated rows: each is scored. An empty table gives an
empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_document, held_out, seldom

#: Most documents of a language that the classifiers learn from, and the number of hashed n-gram features.
SAMPLE_DOCS, FEATURES = 400, 4096
#: Most documents learnt from in all (so many ids are sent to every executor), shared by the languages; but each language gets LEAST_DOCS,
#: however many there are, so that none is left out.
MOST_DOCS, LEAST_DOCS = 25_600, 4
AMBIGUOUS = 0.6
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of hashed letter n-grams (1 to 3, with word ends), None without letters."""
    if not text:
        return None
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[x]
    if not is_letter.any():
        return None
    x = np.where(is_letter, x, np.uint32(0))
    x = np.concatenate([np.zeros(1, np.uint32), x[is_letter | np.append(False, is_letter[:-1])], np.zeros(1, np.uint32)])
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:]
    three = two[:-1] * np.uint32(0x85EBCA77) + x[2:]
    counts = np.zeros(FEATURES, np.int64)
    for h in (x, two, three):
        counts += np.bincount((h * np.uint32(0xC2B2AE3D)) >> shift, minlength=FEATURES)
    out = np.sqrt(counts.astype(np.float32))
    return out / np.float32(np.sqrt((out**2).sum()))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """+-1, one row for each of n languages. Up to six languages: every split of them in two. More: of several random
    codes, the one with the largest least distance."""
    if n <= 6:
        columns = range(1, 1 << max(n - 1, 1)) if n > 1 else [1]
        return np.array([[1 if i == 0 else (-1 if c >> (i - 1) & 1 else 1) for c in columns] for i in range(n)], np.float32)
    rng, best = np.random.default_rng(seed), None
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        gap = (bits - np.abs(code @ code.T) + 2 * bits * np.eye(n)).min()
        if np.abs(code.sum(axis=0)).max() < n and (best is None or gap > best[0]):
            best = (gap, code)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features + 1 (offset) x bits
    trust: np.ndarray  # of bits, sums to the number of bits
    heat: float = 1.0

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Texts x languages; a bit's loss depends on its sign in the codeword alone, so all languages are two products."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        plus, minus = np.logaddexp(0, -margin) * self.trust, np.logaddexp(0, margin) * self.trust
        return (plus @ (self.code > 0).T.astype(np.float32) + minus @ (self.code < 0).T.astype(np.float32)) / len(self.trust)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score, ambiguous."""
        d = self.distances(x)
        p = np.exp(-len(self.trust) / self.heat * (d - d.min(axis=1, keepdims=True)))
        best = d.argmin(axis=1)
        if len(self.langs) == 1:
            score = np.exp(-d[:, 0])
        else:
            score = p[np.arange(len(p)), best] / p.sum(axis=1)
        return best, np.clip(score.astype(np.float64), 0, 1), score < AMBIGUOUS


def fit(x: np.ndarray, lang: list[str], steps: int = 80, rate: float = 0.3) -> Model:
    """Logistic regression of every bit at once, by Adam over all the sample."""
    langs = sorted(set(lang))
    code = codewords(len(langs))
    y = code[[langs.index(v) for v in lang]]
    share = np.array([lang.count(v) for v in langs], np.float32)
    w_row = (len(lang) / len(langs) / share)[[langs.index(v) for v in lang]][:, None]
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    w = np.zeros((x1.shape[1], code.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x1.T @ (-y * w_row / (1 + np.exp(np.clip(y * (x1 @ w), -30, 30)))) / len(x1) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    right = (np.sign(x1 @ w) == y).mean(axis=0)
    trust = np.maximum(2 * right - 1, 1e-3)
    return Model(langs, code, w, (trust / trust.sum() * len(trust)).astype(np.float32))


def tempered(model: Model, x: np.ndarray, lang: list[str]) -> Model:
    """The model with the temperature at which the mean score over the sample is (right + 1) / (all + 2), where that softens it."""
    best = model.predict(x)[0]
    aim = (sum(model.langs[b] == v for b, v in zip(best, lang, strict=True)) + 1) / (len(lang) + 2)
    low, high = 1.0, 1e4
    for _ in range(40 if len(model.langs) > 1 else 0):
        model.heat = (low * high) ** 0.5
        low, high = (model.heat, high) if model.predict(x)[1].mean() > aim else (low, model.heat)
    model.heat = low
    return model


def train(docs: DataFrame) -> Model | None:
    """From the SAMPLE_DOCS documents of each language, outside the held-out fold, whose hashed ids come first."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    langs = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"), F.count("*").alias("rows")).collect()
    if not langs:
        return None
    # A share of the hash values that holds half as many ids again as are wanted: so few rows are ranked by language.
    each = max(LEAST_DOCS, min(SAMPLE_DOCS, MOST_DOCS // len(langs)))
    share = F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], min(1.0, (1.5 * each + 100) / max(1, r["n"])))])[F.col("lang")]
    hashed = F.xxhash64("doc_id")
    few = known.filter(F.pmod(hashed, F.lit(1 << 40)) < share * (1 << 40)).select("doc_id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(F.pmod(hashed, F.lit(1 << 40)), "doc_id")
    chosen = few.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= each).select("doc_id").distinct()
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(seldom(known, chosen)), "doc_id")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(d, v, f.tobytes()) for d, v, t in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True) if (f := features(t)) is not None]
            yield pd.DataFrame(made, columns=["doc_id", "lang", "x"])

    got = sample.mapInPandas(take, "doc_id long, lang string, x binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["lang", "doc_id", "x"], kind="stable")
    x, lang = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]), list(got["lang"])
    model = fit(x, lang)
    return model and tempered(model, x, lang)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                pdf = whole.iloc[at : at + 1024]
                found = [features(t) for t in pdf["text"]]
                some = [i for i, f in enumerate(found) if f is not None]
                lang, score, unsure = np.full(len(pdf), "und", object), np.zeros(len(pdf)), np.zeros(len(pdf), bool)
                if some and model is not None:
                    best, s, a = model.predict(np.stack([found[i] for i in some]))
                    lang[some], score[some], unsure[some] = np.array(model.langs, object)[best], s, a
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": score, "ambiguous": unsure})

    return by_document(docs, run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
