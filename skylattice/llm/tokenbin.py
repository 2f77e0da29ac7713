"""Token ids in files of canonical, length-limited Huffman codes.

A file holds whole documents in order: the code lengths of the whole vocabulary, each document's id and length, the bit
offset at which each block of ids starts, and the codes. Code lengths come from counts over all documents by
package-merge, so no code is longer than MAX_BITS and one table lookup decodes an id. Blocks are independent; the decoder
runs through all blocks of a file in step. Files travel as rows of a table in the shared folder, so that Spark's
writers commit them whole and a lost executor costs a task, not a file.

Defined cases. Columns besides doc_id and text, whatever their names, aren't read. A vocabulary of over 65,536 ids is refused. Null text: empty, so the end id alone. Null doc_id: first in order. Repeated rows: each is stored; equal ids
are ordered by length, then checksum. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_document, staged
from .tokens import WordLevel, encoder

END_ID, MAX_BITS, BLOCK = 2, 16, 1024
FILE_IDS, PART_IDS = 1 << 20, 1 << 22
#: Parts whose sums are ordered together.
GROUP = 1024
MAGIC = b"SKYHUF01"
HEAD = struct.Struct("<8sIIQQII")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code length of each symbol (0: not used), none over max_bits, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need codes of over {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    row, kinds = weights, [np.ones(len(weights), bool)]
    for _ in range(max_bits - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        row = both[at]
        kinds.append(at < len(weights))
    take = 2 * len(weights) - 2
    for single in reversed(kinds):
        n = int(single[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        span = np.uint64(1) << (np.uint64(63) - lengths[order].astype(np.uint64))  # share of the code space
        start = np.concatenate([[np.uint64(0)], np.cumsum(span)[:-1]])
        codes[order] = start >> (np.uint64(63) - lengths[order].astype(np.uint64))
    return codes


def decode_table(lengths: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each value of the next max_bits bits."""
    symbol, length = np.zeros(1 << max_bits, np.uint32), np.ones(1 << max_bits, np.uint8)
    codes = canonical_codes(lengths).astype(np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    reach = (1 << (max_bits - lengths[used].astype(np.int64)))
    total = int(reach.sum())
    symbol[:total] = np.repeat(used, reach)
    length[:total] = np.repeat(lengths[used], reach)
    assert not len(used) or codes[used[0]] == 0
    return symbol, length


def encode_file(doc_ids: list[int | None], ids: list[np.ndarray], lengths: np.ndarray, max_bits: int = MAX_BITS, block: int = BLOCK) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
    n = len(flat)
    size = lengths[flat].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    code = canonical_codes(lengths)[flat]
    words = np.zeros((int(ends[-1]) if n else 0) // 64 + 2, np.uint64)
    if n:
        word = starts >> 6
        shift = 64 - (starts & 63) - size
        over = np.flatnonzero(shift < 0)
        high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)  # at most one code runs over into a word
    table = zlib.compress(lengths.tobytes())
    index = np.array([len(x) for x in ids], "<u8").tobytes()
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    marks = starts[::block].astype("<u8").tobytes()
    return b"".join([HEAD.pack(MAGIC, max_bits, block, n, len(ids), len(lengths), len(table)), table, names, index, marks, words.astype(">u8").tobytes()])


_tables: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray]] = {}


def decode_file(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Document ids and their token ids."""
    magic, max_bits, block, n, n_docs, n_symbols, n_table = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a file of Huffman-coded token ids")
    at = HEAD.size
    packed, at = data[at : at + n_table], at + n_table
    names = np.frombuffer(data, "<i8", n_docs, at)
    nulls = data[at + 8 * n_docs : at + 9 * n_docs]
    sizes = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    n_blocks = -(-n // block)
    pos = np.frombuffer(data, "<u8", n_blocks, at).astype(np.int64)
    at += 8 * n_blocks
    if (key := (max_bits, packed)) not in _tables:
        _tables.clear()
        _tables[key] = decode_table(np.frombuffer(zlib.decompress(packed), np.uint8), max_bits)
    symbol, length = _tables[key]
    half = np.frombuffer(data, ">u2", offset=at).astype(np.uint32)
    pair = np.append((half[:-1] << np.uint32(16)) | half[1:], np.zeros(2, np.uint32))
    out = np.zeros((block, n_blocks), np.uint32)
    last = n - (n_blocks - 1) * block if n else 0
    for i in range(min(block, n)):
        if i == last:  # the last block is shorter
            pos = pos[:-1]
            if not len(pos):
                break
        peek = (pair[pos >> 4] >> (32 - max_bits - (pos & 15)).astype(np.uint32)) & np.uint32((1 << max_bits) - 1)
        out[i, : len(pos)] = symbol[peek]
        pos = pos + length[peek]
    flat = out.T.reshape(-1)[:n].astype("<u4")
    ends = np.cumsum(sizes)
    return [None if z else int(d) for d, z in zip(names, nulls, strict=True)], [flat[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n and ids (little-endian unsigned 16-bit where the vocabulary allows)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(WordLevel, path)
        if max(coder.size, end_id + 1) > 1 << 16:
            raise ValueError(f"{path} has {coder.size} ids; these files hold ids of 16 bits")
        for pdf in batches:
            ids = [np.append(coder.ids(t), np.array([end_id], "<u4")).astype("<u2") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]})

    return by_document(docs, run, "doc_id long, n long, ids binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, np.int64)
        for pdf in batches:
            total += np.bincount(np.frombuffer(b"".join(pdf["ids"]), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    out = np.zeros(1 << 16, np.int64)
    for r in tokens.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():  # at most 65,536 rows
        out[r["id"]] = r["n"]
    return out


def write_files(tokens: DataFrame) -> DataFrame:
    """Files as rows: part, seq (their order), n_ids, file."""
    lengths = code_lengths(id_counts(tokens))
    total = tokens.agg(F.sum("n")).head()[0] or 0

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, names, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "n_ids": [held], "file": [encode_file(names, ids, lengths)]})

        for pdf in batches:
            for doc, x in zip(pdf["doc_id"], pdf["ids"], strict=True):
                names.append(None if doc is None else int(doc))
                ids.append(np.frombuffer(x, "<u2"))
                held += len(ids[-1])
                if held >= FILE_IDS:
                    yield out()
                    seq, names, ids, held = seq + 1, [], [], 0
        if names:
            yield out()

    # Rows of one id may be many: what follows the id in the key lets them go to several tasks, in a defined order.
    order = ["doc_id", "n", "_crc", "_row"]
    ordered = tokens.withColumns({"_crc": F.crc32("ids"), "_row": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(max(1, -(-total // PART_IDS)), *order).sortWithinPartitions(*order)
    ordered = ordered.select(F.col("doc_id").cast("string"), "ids")  # exact in pandas beside nulls
    return staged(ordered.mapInPandas(encode, "part int, seq int, n_ids long, file binary"))


def before_each(files: DataFrame) -> DataFrame:
    """part, seq and base, the ids of all files before. Sums go by part and by GROUP parts, so that what one task orders is no more than the
    files of a part, GROUP parts, or the groups."""
    ahead = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    group = F.floor(F.col("part") / GROUP).alias("group")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(group, "part", "n")
    groups = parts.groupBy("group").agg(F.sum("n").alias("n")).select("group", upto("n", ahead("group")).alias("_g"))
    parts = parts.select("group", "part", upto("n", ahead("group", "part")).alias("_p")).join(groups, "group")
    each = files.select("part", "seq", upto("n_ids", ahead("part", "seq")).alias("_s"))
    return each.join(parts, "part").select("part", "seq", (F.col("_g") + F.col("_p") + F.col("_s")).alias("base"))


def read_files(files: DataFrame) -> DataFrame:
    """Each document of the files with start (ids before it in all files), n_tokens and ids_crc32."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, seq, data in zip(pdf["part"], pdf["seq"], pdf["file"], strict=True):
                names, ids = decode_file(data)
                n = np.array([len(x) for x in ids], np.int64)
                yield pd.DataFrame({"part": part, "seq": seq, "doc_id": pd.array(names, "Int64"), "at": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]})

    base = before_each(files.select("part", "seq", "n_ids"))
    docs = files.select("part", "seq", "file").mapInPandas(decode, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents")
    return read_files(write_files(staged(tokenized(docs, public_tokenizers.path("word_bpe_49k.json")))))
