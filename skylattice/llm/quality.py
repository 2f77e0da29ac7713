"""Quality scores from supervised subword embeddings.

A text is the average of learned vectors, hashed, of its words and of the character 3- and 4-grams inside them, and of one
vector for each word that repeats the word before it; a softmax layer on that average tells label 1 from label 0. Vectors and layer are trained together by stochastic gradient descent in
numpy. Once trained, a feature's vector only ever meets the layer's difference of two columns, so scoring looks up one number
for each feature and averages.

Defined cases. Columns besides doc_id and text (of labels: doc_id and quality), whatever their names, aren't read and stay in score and keep. Null or empty text, or one without words: the score is that of the layer's offsets alone, the share of label 1
as learnt. No usable label: every score is 0.5. Several labels for a document: each is learnt from. Null label: not learnt
from. Null doc_id: held out; scored. Repeated rows: each is scored. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import held_out, seldom, small_batches
from .hashing import IS_SPACE, P, as_bytes, mixed, word_bounds, word_hashes

#: Most labelled documents learnt from; hashed rows for words and for n-grams; vector length; passes.
SAMPLE_DOCS, WORD_ROWS, GRAM_ROWS, WIDTH, PASSES = 3000, 1 << 17, 1 << 17, 8, 6
REPEAT_ROW = WORD_ROWS + GRAM_ROWS
THRESHOLD = 0.3


def feature_rows(text: str | None) -> np.ndarray:
    """Row number of each feature, in order of the text, words first."""
    x = as_bytes(text)
    starts, ends = word_bounds(x)
    if not len(starts):
        return np.empty(0, np.int64)
    hashes = word_hashes(x, starts, ends)
    words = hashes & np.uint64(WORD_ROWS - 1)
    again = int((hashes[1:] == hashes[:-1]).sum())
    gap = IS_SPACE[x]
    keep = ~gap | np.append(False, ~gap[:-1])  # one space after each word
    y = np.concatenate([[32], np.where(gap, 32, x)[keep], [32]]).astype(np.uint64)
    gap = y == 32
    out = [words.astype(np.int64), np.full(again, REPEAT_ROW)]
    h = y[:-1] * np.uint64(P) + y[1:]
    inner = np.zeros(len(y), bool)
    for n in (3, 4):
        h = h[:-1] * np.uint64(P) + y[n - 1 :] if len(h) > 1 else h[:0]
        inner = gap[1:-1] if n == 3 else inner[:-1] | gap[2:-1]
        out.append(((mixed(h) & np.uint64(GRAM_ROWS - 1)).astype(np.int64) + WORD_ROWS)[~inner])
    return np.concatenate(out)


@dataclass
class Model:
    """difference: for each feature row, its vector against the layer; offset: of the two classes."""

    difference: np.ndarray
    offset: float

    def score(self, text: str | None) -> float:
        rows = feature_rows(text)
        z = self.offset + (float(self.difference[rows].mean(dtype=np.float64)) if len(rows) else 0.0)
        return float(1 / (1 + np.exp(-z)))


def fit(rows: list[np.ndarray], counts: list[np.ndarray], label: np.ndarray, seed: int = 11, rate: float = 1.0) -> Model:
    """rows, counts: each document's distinct features and how often it has them."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (REPEAT_ROW + 1, WIDTH)).astype(np.float32)
    layer, offset = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    steps, done = PASSES * len(rows), 0
    weigh = [(c / max(c.sum(), 1)).astype(np.float32) for c in counts]
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            r, w, lr = rows[i], weigh[i], np.float32(rate * (1 - done / steps))
            done += 1
            hidden = w @ vectors[r]
            z = hidden @ layer + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            offset -= lr * np.float32(0.1) * p
            vectors[r] -= (lr * len(r) ** 0.5) * w[:, None] * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(offset[1] - offset[0]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From at most SAMPLE_DOCS labelled documents outside the held-out fold, those whose hashed ids come first."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(SAMPLE_DOCS)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text, label in zip(pdf["doc_id"], pdf["text"], pdf["_label"], strict=True):
                rows, counts = np.unique(feature_rows(text), return_counts=True)
                yield pd.DataFrame({"doc_id": [doc], "label": [label], "rows": [rows.astype("<i4").tobytes()], "counts": [counts.astype("<i4").tobytes()]})

    chosen = chosen.join(F.broadcast(seldom(docs, chosen.select("doc_id").distinct())), "doc_id")
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(take, "doc_id long, label int, rows binary, counts binary").toPandas()
    if got.empty:
        return Model(np.zeros(REPEAT_ROW + 1, np.float32), 0.0)
    got = got.sort_values(["doc_id", "label", "rows"], kind="stable")
    read = lambda c: [np.frombuffer(b, "<i4").astype(np.int64) for b in got[c]]
    return fit(read("rows"), read("counts"), got["label"].to_numpy())


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs and the score of its text, as a column of that name."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([model.score(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier, learnt from labels, rejects."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels), name).filter(F.col(name) >= THRESHOLD).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = score(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
