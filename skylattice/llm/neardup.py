"""Near-duplicate classes by Order MinHash.

Texts with the same words are one node. A node's five-word shingles are labelled with their occurrence numbers; each of BANDS
sketches takes the LENGTH smallest under its own hash and keeps them in text order, so that nodes meet in a bucket when they
share these shingles in the same order. Where a pair may have one node of fewer than EXACT shingles, sketches would miss too
many, and all choices of LENGTH (or all common) shingles that such a pair can share are keys too: these pairs meet with certainty.
Candidates are verified by a banded alignment: the longest common subsequence L of the labelled shingles, within the band that the
threshold leaves, must make L / (a + b - L) at least 0.8; or so must that of the shingles' first occurrences, so that texts which
repeat themselves unequally often are judged by what they say; first occurrences have keys of their own where they differ. Classes are the connected components of the verified links.

A bucket is never expanded into all its pairs as rows. First its members meet one pivot. What is then still apart in a bucket is
compared in full, in pairs of blocks, inside tasks: a bound on common shingles, from the cells of a bitmap that they fill, rules out
most pairs, the others are aligned unless they have come together meanwhile, and only links that join two classes leave the task.
So no link between texts of a bucket is lost, and one large class costs a row for each member.

Defined cases. Columns besides doc_id and text, whatever their names, aren't read, and stay in one_of_each. Null or empty text, or one without words: a class of its own. Fewer than five words: the whole text is the one
shingle, so only equal texts meet. Null doc_id: gets its class's id, the least doc_id in it (null if there is none). An id of
different texts: each text is in its own class, and class_label tells classes apart whose least doc_id is the same. Repeated rows:
one class, each row returned. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged
from .hashing import as_bytes, mixed, windows, word_bounds, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, LENGTH, SEED = 32, 6, 97
#: Pairs of which one has fewer shingles than this meet with certainty.
EXACT = 16
#: Members of one block when the rest of a bucket is compared in full, and cells of a bitmap.
BLOCK, CELLS = 256, 1024


def node_of(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def shingles(h: np.ndarray) -> np.ndarray:
    """Occurrence-labelled hashes of the shingles, in text order, each value once. The lowest bit tells a first occurrence."""
    s = windows(h, WORDS) if len(h) >= WORDS else windows(h, len(h)) if len(h) else h
    if not len(s):
        return s
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    first = np.append(True, ranked[1:] != ranked[:-1])
    at = np.arange(len(s))
    occurrence = np.empty(len(s), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    labelled = mixed(s + occurrence * np.uint64(0xD6E8FEB86659FD93))
    return labelled & ~np.uint64(1) | (occurrence == 0)


_odd = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(s: np.ndarray) -> np.ndarray:
    """One bucket key for each band."""
    n = min(LENGTH, len(s))
    keys = np.empty(BANDS, np.uint64)
    step = max(1, 1_000_000 // max(len(s), 1))
    for b in range(0, BANDS, step):
        odd = _odd[b : b + step]
        v = s[None, :] * odd[:, None]
        at = np.argpartition(v, n - 1, axis=1)[:, :n] if len(s) > n else np.tile(np.arange(n), (len(odd), 1))
        chosen = s[np.sort(at, axis=1)]  # text order
        key = odd.copy()
        for k in range(n):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + chosen[:, k])
        keys[b : b + step] = key
    return keys


@cache
def choices(n: int) -> list[np.ndarray]:
    """Which of a node's n shingles, by rank of their values, make the keys by which it meets all nodes similar to it, if it or they
    have fewer than EXACT; a row for each key. A similar node of m shingles has `least` in common with it in the same order, so at most
    n - least others are among the smallest before the k smallest common ones. There are 84 keys at most."""
    longest: dict[int, int] = {}
    for m in range(1, n * 5 // 4 + 1 if 4 * n <= 5 * (EXACT - 1) else 1):
        least = -(-4 * (n + m) // 9)  # of common / all >= 0.8
        if least <= min(n, m) and min(n, m) < EXACT:
            k = min(LENGTH, least)
            longest[k] = max(longest.get(k, 0), n - least + k)
    return [np.array(list(combinations(range(size), k))) for k, size in sorted(longest.items())]


_short = np.uint64(0xA24BAED4963EE407)  # apart from the bands


def exact_keys(s: np.ndarray) -> np.ndarray:
    """Bucket keys of few shingles."""
    by_value, keys = np.argsort(s, kind="stable"), []
    for ranks in choices(len(s)):
        chosen = s[np.sort(by_value[ranks], axis=1)]  # text order
        key = np.full(len(chosen), _short + np.uint64(ranks.shape[1]))
        for k in range(ranks.shape[1]):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + chosen[:, k])
        keys.append(key)
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def bucket_keys(s: np.ndarray) -> np.ndarray:
    """All bucket keys of a node, each once: those of its shingles and, as aligned() judges by these too, of their first occurrences."""
    first = first_ones(s)
    both = [s, first] if len(first) < len(s) else [s]
    return np.unique(np.concatenate([exact_keys(x) for x in both] + [sketch(x) for x in both if len(x) >= EXACT]))


def aligned(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the banded alignment of two sequences of labelled shingles, or of their first occurrences, is similar enough."""
    if reaches(a, b):
        return True
    x, y = first_ones(a), first_ones(b)
    return (len(x) < len(a) or len(y) < len(b)) and reaches(x, y)


def first_ones(s: np.ndarray) -> np.ndarray:
    return s[(s & s.dtype.type(1)).astype(bool)]


def reaches(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the banded alignment of two sequences of distinct values reaches the similarity."""
    least = similarity / (1 + similarity) * (len(a) + len(b)) - 1e-9
    if min(len(a), len(b)) < least:
        return False
    if len(a) == len(b) and np.array_equal(a, b):
        return True
    _, i, j = np.intersect1d(a, b, return_indices=True)
    inside = np.abs(i - j) <= max(len(a), len(b)) - least
    i, j = i[inside], j[inside]
    if len(i) < least:
        return False
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        return True
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails) >= least


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (null without words) and bucket keys of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                pdf, nodes, keys = whole.iloc[at : at + 512], [], []
                for text in pdf["text"]:
                    x = as_bytes(text)
                    h = word_hashes(x, *word_bounds(x))
                    nodes.append(node_of(h) if len(h) else None)
                    keys.append(bucket_keys(shingles(h)).view(np.int64) if len(h) else None)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "node": nodes, "keys": keys})

    told = docs.select(F.col("doc_id").cast("long").cast("string"), F.xxhash64("text").alias("text_hash"), "text")
    out = told.mapInPandas(run, "doc_id string, text_hash long, node binary, keys array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _shingled(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """node and its shingles (32 bits each), read from the document that owns the node. It is found by its id and its text's hash, so that
    an id which many rows share, or which they lack, doesn't match each of them with each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for node, text in zip(pdf["node"], pdf["text"], strict=True):
                x = as_bytes(text)
                h = word_hashes(x, *word_bounds(x))
                if node_of(h) == node:  # whatever the hash says
                    rows.append((node, shingles(h).astype(np.uint32).tobytes()))
            yield pd.DataFrame(rows, columns=["node", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    texts = texts.join(owners, F.col("_id").eqNullSafe(F.col("_own.doc_id")) & (F.col("_hash") == F.col("_own.text_hash")))
    return texts.select("node", "text").mapInPandas(run, "node binary, s binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, s: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = lambda c: [np.frombuffer(x, np.uint32) for x in pdf[c]]
            good = [aligned(x, y) for x, y in zip(read("sa"), read("sb"), strict=True)]
            yield pdf.loc[good, ["a", "b"]]

    both = pairs.join(s.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(s.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    return both.mapInPandas(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for all nodes of links (a, b) that aren't themselves the least.
    Each round hangs every node under its least smaller neighbour, follows the trees to their roots and contracts the links to
    links between roots."""
    pair = lambda x, y: links_of.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a != b").distinct()
    links_of, total = links, None
    while True:
        edges = staged(pair(F.col("a"), F.col("b")))
        if not edges.limit(1).count():
            return total if total is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        up = edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
        moved = 1
        while moved:
            up = staged(up)
            over = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
            up = staged(up.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label"), F.col("top").isNotNull().alias("moved")))
            moved = up.filter("moved").limit(1).count()
            up = up.select("node", "label")
        root = lambda df, c, new: df.join(up.select(F.col("node").alias(c), F.col("label").alias(new)), c, "left")  # noqa: E731, B023
        links_of = root(root(edges, "a", "_ra"), "b", "_rb").select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b"))
        total = up if total is None else staged(root(total, "label", "_r").select("node", F.coalesce("_r", "label").alias("label")).union(up))


def plausible(s: list[np.ndarray]) -> np.ndarray:
    """Pairs (i > j) that may be similar, by all shingles or by first occurrences."""
    ok, first = _bounded(s), [first_ones(x) for x in s]
    if any(len(x) < len(y) for x, y in zip(first, s, strict=True)):
        ok |= _bounded(first)
    i, j = np.nonzero(np.tril(ok, -1))
    return np.stack([i, j], axis=1)


def _bounded(s: list[np.ndarray]) -> np.ndarray:
    """Common shingles are at most a's shingles less the cells that a fills and b doesn't, so no similar pair is ruled out."""
    n = np.array([len(x) for x in s], np.float64)
    bits = np.zeros((len(s), CELLS), np.float32)
    for i, x in enumerate(s):
        bits[i, x >> np.uint32(1) & np.uint32(CELLS - 1)] = 1
    common, filled = bits @ bits.T, bits.sum(axis=1)
    most = np.minimum((n - filled)[:, None], (n - filled)[None, :]) + common
    least = SIMILARITY / (1 + SIMILARITY) * (n[:, None] + n[None, :]) - 1e-6
    return (most >= least) & (np.minimum(n[:, None], n[None, :]) >= least)


def _compared(members: DataFrame, s: DataFrame) -> DataFrame:
    """Links between classes (a, b: labels) that full comparison of the members of each bucket finds."""
    spark = members.sparkSession
    size = members.groupBy("key").agg(F.count("*").alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    m = members.join(size, "key").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    m = m.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    m = m.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own, found = pdf["_own"].to_numpy(), []
        s = [np.frombuffer(x, np.uint32) for x in pdf["s"]]
        under = {v: v for v in pdf["label"]}

        def root(v: bytes) -> bytes:
            while under[v] != v:
                under[v] = v = under[under[v]]
            return v

        label, across = pdf["label"].tolist(), pdf["_lo"].iat[0] != pdf["_hi"].iat[0]
        for i, j in plausible(s).tolist():
            if across and own[i] == own[j]:
                continue
            x, y = root(label[i]), root(label[j])
            if x != y and aligned(s[i], s[j]):
                found.append((max(x, y), min(x, y)))
                under[max(x, y)] = min(x, y)
        return pd.DataFrame(found, columns=["a", "b"])

    keys = ["key", "_lo", "_hi"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = m.join(s, "node").repartition(parts, *keys)  # small rows, long work: not to be put together to few tasks
    return dealt.groupBy(*keys).applyInPandas(compare, "a binary, b binary")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash and node (null without words) of each document; node, label and _own, its least document, of each node. A
    class is a label: its least doc_id may be that of other classes too, where different texts share an id."""
    known = staged(sketches(docs))
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash")))
    owners = known.filter("node IS NOT NULL").groupBy("node").agg(least.alias("_own"))
    bands = known.filter("node IS NOT NULL").select("node", F.explode("keys").alias("key"))  # a key tells its band
    shared = bands.groupBy("key").agg(F.min("node").alias("_x"), F.max("node").alias("_y")).filter("_x != _y").select("key")
    members = staged(bands.join(shared, "key").distinct())
    within = members.select("node").distinct()
    s = staged(_shingled(docs, owners.join(within, "node")))
    release(docs.sparkSession)
    pivot = members.groupBy("key").agg(F.min("node").alias("b"))
    pairs = members.join(pivot, "key").filter("node != b").select(F.col("node").alias("a"), "b").distinct()
    first = components(_verified(pairs, s))
    left = members.join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = left.groupBy("key").agg(F.min("label").alias("_x"), F.max("label").alias("_y"), F.count("*").alias("_m")).filter("_x != _y AND _m > 2").select("key")
    second = components(_compared(left.join(apart, "key"), s)).select(F.col("node").alias("label"), F.col("label").alias("_top"))
    labels = members.select("node").distinct().join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labels = labels.join(second, "label", "left").select("node", F.coalesce("_top", "label").alias("label"))
    nodes = owners.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return known, nodes


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and class_label of each document. class_label differs between all classes."""
    known, nodes = _labelled(docs)
    least = nodes.groupBy("label").agg(F.min("_own.doc_id").alias("class_id"))
    nodes = nodes.join(least, "label").select("node", "class_id", "label")
    out = known.select("doc_id", "text_hash", "node").join(nodes, "node", "left")
    alone = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex("text_hash"))
    wordless = F.col("node").isNull()
    return out.select("doc_id", F.when(wordless, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(wordless, alone).otherwise(F.hex("label")).alias("class_label"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each class: that with the least doc_id (documents without an id come last) and, of these,
    the least text hash. Of rows that repeat an id, or none, and its text one stays."""
    known, nodes = _labelled(docs)
    least = nodes.groupBy("label").agg(F.min("_own").alias("_own")).select(F.col("_own.doc_id").alias("_id"), F.col("_own.text_hash").alias("_hash"), F.lit(True).alias("_least"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    rows = known.groupBy("doc_id", "text_hash").agg(F.count("*").alias("count"), F.max(F.col("node").isNull()).alias("wordless"))
    kept = staged(rows.join(least, same, "left").filter("_least OR wordless").select("doc_id", "text_hash", "count"))
    del known, nodes, least, rows
    release(docs.sparkSession)
    names = [f"_{c}" for c in ("id", "hash")]
    while set(names) & set(docs.columns):
        names = [f"{c}_" for c in names]
    told = docs.withColumns(dict(zip(names, (F.col("doc_id").cast("long"), F.xxhash64("text")), strict=True)))
    own = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"), "count")
    same = told[names[0]].eqNullSafe(own["_kept_id"]) & (told[names[1]] == own["_kept_hash"])
    once = told.join(own.filter("count = 1"), same, "left_semi")
    many = told.join(own.filter("count > 1"), same, "left_semi").dropDuplicates(names)
    return once.unionByName(many).drop(*names)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return classes(table(spark, sf_dir, "documents"))
