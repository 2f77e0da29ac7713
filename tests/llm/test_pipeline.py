import numpy as np

import corpus_pipeline
from skylattice.llm import langid  # noqa: F401
from skylattice.llm import mixing, neardup, packing, pii, quality
from tests.compare import SMALL


def test_stages_follow_the_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "pack"]


def test_run_equals_plain_stages(spark):
    """Each stage's decisions made again, row by row, from the same learnt models."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(docs, labels)
    pdf = docs.toPandas()
    pdf = pdf[[m.score(t) >= quality.THRESHOLD for t in pdf["text"]]].sort_values("doc_id")
    seqs, kept = [], []
    from skylattice.llm.hashing import as_bytes, word_bounds, word_hashes

    up = {}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
        x = as_bytes(text)
        s = neardup.shingles(word_hashes(x, *word_bounds(x))).astype(np.uint32)
        up[doc] = doc
        for other, t in seqs:
            if len(s) and len(t) and neardup.aligned(s, t):
                a, b = root(doc), root(other)
                up[max(a, b)] = min(a, b)
        seqs.append((doc, s))
    kept = [d for d in pdf["doc_id"] if root(d) == d]
    pdf = pdf[pdf["doc_id"].isin(kept)]
    left = spark.createDataFrame(pdf, docs.schema)
    net = pii.train(left)
    pdf["text"] = [pii.redacted(t, base + more) for t, (base, more) in zip(pdf["text"], pii.find(net, list(pdf["text"])), strict=True)]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(pdf, docs.schema)).collect()}
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    from skylattice.llm.tokens import ByteLevel
    import public_tokenizers

    coder = ByteLevel(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
        if copies[doc]:
            n = len(coder.ids(text)) + 1
            for k, (s, size) in enumerate(packing.cuts(n)):
                want[doc, k, s, size] = copies[doc]
    have = got.groupby(["doc_id", "piece", "start", "length"]).size().to_dict()
    assert have == want
    assert got.groupby("sequence_id")["length"].sum().max() <= 1024
    again = corpus_pipeline.run(spark, SMALL).groupBy("doc_id", "piece", "ids_crc32").count().toPandas()
    first = got.groupby(["doc_id", "piece", "ids_crc32"]).size().to_dict()
    assert first == {(r.doc_id, r.piece, r.ids_crc32): r.count_ for r in again.rename(columns={"count": "count_"}).itertuples()}


def test_odd_and_no_documents(spark, odd_docs, no_docs, tmp_path):
    """Nulls, long texts, repeated rows and clashing columns go through all stages; an empty table gives nothing."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        if name == "none":
            assert not got
            continue
        ids = {r["doc_id"] for r in got}
        assert ids and ids <= {r["doc_id"] for r in odd_docs.select("doc_id").collect()} and not {1, 5} <= ids
        bins = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for one in map(sorted, bins.values()):
            assert all(at == sum(n for _, n in one[:i]) for i, (at, _) in enumerate(one)) and sum(n for _, n in one) <= 1024


def test_only_the_last_table_stays(spark, monkeypatch):
    """Tables of stages go once the next one is written."""
    import os

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("quality", lambda s, d, f: d.filter("doc_id % 2 = 0")), ("mix", lambda s, d, f: d.filter("doc_id % 3 = 0")), ("pack", lambda s, d, f: d.select("doc_id"))])
    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 0 and all(r["doc_id"] % 6 == 0 for r in got.collect())
    folder = os.path.dirname(got.inputFiles()[0].removeprefix("file://"))
    assert os.listdir(os.path.dirname(folder)) == ["2-pack"]
