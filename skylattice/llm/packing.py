"""Best-fit packing of token sequences with certified bin counts.

Documents are tokenized and only those over the limit are cut. Pieces are dealt evenly to partitions; each is packed by
best-fit decreasing and its bin count is compared with a lower bound from dual feasible functions. Where they
meet, the partition is certified optimal. Pieces in bins with gaps (all of an uncertified partition's, and the badly
filled ones of the others) are exchanged: they are pooled, dealt anew to fewer partitions and packed again, as
long as that saves sequences and the bound over all pieces isn't met.

Defined cases. Columns besides doc_id and text, whatever their names, aren't read. Null text: empty, so one piece that holds the end id alone. Null doc_id: kept as null. Repeated rows: each
row is packed. Ties: of equally long pieces of a partition those that come first in its table are packed first, and of bins of equal room the one
that was filled last takes the piece; either way the number of sequences is the same. An empty table gives an empty result. Very long texts: cut, the first piece takes what is left over.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_document, staged
from .tokens import ByteLevel, encoder

LIMIT, END_ID = 1024, 2
#: Pieces that a partition packs, on average.
PART_ROWS = 8192
#: A certified partition gives away bins filled to less than this share.
FILLED = 0.97
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids."""
    first = n % limit or limit
    return [(0, min(n, first)), *((s, limit) for s in range(first, n, limit))]


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(ByteLevel, path)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.append(coder.ids(text), np.array([end_id], "<u4")).astype("<u4")
                rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts(len(ids), limit))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return by_document(docs, cut, PIECES)


def lower_bound(counts: np.ndarray, limit: int = LIMIT) -> int:
    """Least number of bins for counts[x] items of length x, by two families of dual feasible functions: the
    thresholds (over limit - e: 1, under e: 0, else x / limit) and the roundings (floor((k + 1) x / limit) / k, or
    x / limit where (k + 1) x / limit is whole). Integer arithmetic, so the bound is exact."""
    x = np.arange(len(counts), dtype=np.int64)
    c = counts.astype(np.int64)
    n_above = np.cumsum(c[::-1])[::-1]  # items of length >= i
    mass = np.append(0, np.cumsum(c * x))  # of items shorter than i
    best = 0
    for e in range(0, limit // 2 + 1):
        large = int(n_above[limit - e + 1]) if limit - e + 1 < len(counts) else 0
        inner = int(mass[min(limit - e, len(counts) - 1) + 1] - mass[min(e, len(counts))])
        best = max(best, large - (-inner // limit))
    for k in range(1, 33):
        whole = (k + 1) * x % limit == 0
        linear = int((c * x)[whole].sum())
        steps = int((c * ((k + 1) * x // limit))[~whole].sum())
        best = max(best, -(-(linear * k + steps * limit) // (limit * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin. The fullest bin that still takes the item gets it; open
    bins are kept by the room they have, with one bit for each room that occurs."""
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = (fits & -fits).bit_length() - 1 + n
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(fill), limit
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            by_room[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def _packed(items: DataFrame, rows: int, turn: int, limit: int) -> DataFrame:
    parts = max(1, -(-rows // PART_ROWS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, limit)
        bound = lower_bound(np.bincount(lengths, minlength=limit + 1), limit)
        base = (turn << 53) + (int(pdf["_part"].iloc[0]) << 24)
        return pdf.drop(columns="_part").assign(sequence_id=base + bins, offset=offsets, _fill=fill[bins], _sure=len(fill) == bound)

    dealt = items.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts)).cast("int"))
    out = dealt.groupBy("_part").applyInPandas(pack, f"{PIECES.replace('doc_id long', 'doc_id string')}, sequence_id long, offset long, _fill long, _sure boolean")
    return staged(out)


def pack(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """items: the columns of PIECES. Adds sequence_id and offset."""
    columns = items.columns
    items = staged(items.withColumn("doc_id", F.col("doc_id").cast("string")))  # exact in pandas beside nulls
    counts = np.zeros(limit + 1, np.int64)
    for r in items.groupBy("length").count().collect():  # a row for each length, so at most `limit`
        counts[r["length"]] = r["count"]
    bound, out = lower_bound(counts, limit), _packed(items, int(counts.sum()), 0, limit)
    for turn in itertools.count(1):  # ends, as each round but the last saves a sequence
        loose = (F.col("_fill") < limit) & (~F.col("_sure") | (F.col("_fill") < FILLED * limit))
        bins = out.agg(F.countDistinct("sequence_id"), F.count(F.when(loose, 1)), F.countDistinct(F.when(loose, F.col("sequence_id")))).head()
        if bins[0] <= bound or not bins[1]:
            break
        again = _packed(out.filter(loose).select(*columns), bins[1], turn, limit)
        if again.select("sequence_id").distinct().count() >= bins[2]:
            break
        out = out.filter(~loose).unionByName(again)
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    return pack(pieces(docs, path))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
