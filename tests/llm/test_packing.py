import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skylattice.llm import packing
from skylattice.llm.common import staged

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, limit):
    """Brute force: every way to put items into bins, largest first."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= limit:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_bound_never_passes_the_optimum():
    r = random.Random(3)
    for _ in range(60):
        limit = r.choice([10, 16, 30])
        lengths = sorted((r.randint(1, limit) for _ in range(r.randint(0, 8))), reverse=True)
        bound = packing.lower_bound(np.bincount(lengths, minlength=limit + 1), limit)
        assert max(-(-sum(lengths) // limit), sum(2 * x > limit for x in lengths)) <= bound <= fewest(lengths, limit)


def test_best_fit_is_gapless_and_within_the_limit():
    lengths = np.random.default_rng(0).integers(1, 1025, 500)
    bins, offsets, fill = packing.best_fit_decreasing(lengths)
    assert fill.max() <= 1024 and fill.sum() == lengths.sum()
    for b in range(len(fill)):
        at = np.sort(offsets[bins == b])
        assert at[0] == 0 and np.array_equal(np.sort(offsets[bins == b] + lengths[bins == b])[:-1], at[1:])


def test_cuts():
    for n, want in ((1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])):
        assert packing.cuts(n) == want


def check(df, out):
    rows, got = out.collect(), out.toPandas()
    coder = Tokenizer.from_file(PATH)
    want = []
    for doc, text in df.select("doc_id", "text").collect():
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(doc if doc is not None else -1, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids)))]
    assert sorted(want) == sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 1024 and (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all()


def test_odd_documents(spark, odd_docs, no_docs):
    check(odd_docs, staged(packing.pack_documents(odd_docs, PATH)))
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_exchange_saves_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 40)
    lengths = np.random.default_rng(5).integers(200, 700, 2000)
    items = spark.createDataFrame([(int(i), 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)
    out = packing.pack(items).toPandas()
    alone = packing._packed(items.selectExpr("cast(doc_id as string) doc_id", "piece", "start", "length", "ids_crc32"), 2000, 0, 1024).select("sequence_id").distinct().count()
    bins = out["sequence_id"].nunique()
    assert bins <= alone and len(out) == 2000 and bins >= packing.lower_bound(np.bincount(lengths, minlength=1025))
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024
    assert list(itertools.islice(out.columns, 5)) == ["doc_id", "piece", "start", "length", "ids_crc32"]


def test_exchange_goes_on_as_long_as_it_saves(spark, monkeypatch):
    """Rounds end by themselves: when the bound is met, nothing is loose, or the last round saved nothing."""
    monkeypatch.setattr(packing, "PART_ROWS", 12)
    turns, real = [], packing._packed
    monkeypatch.setattr(packing, "_packed", lambda items, rows, turn, limit: turns.append((turn, rows)) or real(items, rows, turn, limit))
    lengths = np.random.default_rng(6).integers(300, 800, 400)
    out = packing.pack(spark.createDataFrame([(int(i), 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)).toPandas()
    assert [t for t, _ in turns] == list(range(len(turns))) and all(b[1] <= a[1] for a, b in itertools.pairwise(turns))
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024 and len(out) == 400
