import hashlib
import random
import re
import zlib

import duckdb
import pandas as pd

from skylattice.llm import trie
from tests.compare import SMALL, connect, rows


def plain(turns):
    """The contract's nodes from (conv_id, turn, role, text) rows, turn by turn."""
    own = {}
    for c, t, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        made = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(made) + 1):
            nodes.setdefault(made[:d], []).append((c, len(made) == d))
    kids, out = {}, []
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [sums[k] for k in kids.get(p, [])]
        sums[p] = (sum(b[0] for b in below) or int(not below), (len(nodes[p]) - 1) * words + sum(b[1] for b in below))
    for p, members in nodes.items():
        parent = min(c for c, _ in nodes[p[:-1]]) if p else None
        ends = ",".join(str(c) for c in sorted(c for c, last in members if last))
        out.append((min(c for c, _ in members), len(p), parent, len(members), len(kids.get(p, [])), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return pd.DataFrame(out, columns="conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split())


def check(spark, turns, parts=3):
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, c string, name int").repartition(parts)
    got = trie.trie(*trie.rebuilt(*trie.ordered(df))).toPandas()
    assert rows(got) == rows(plain(turns))
    return got


def test_query_equals_sql_and_plain(spark):
    got = trie.query(spark, SMALL).toPandas()
    assert rows(got) == rows(connect().sql(trie.ORACLE).df())
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert rows(got) == rows(plain([tuple(r) for r in turns]))


def test_odd_turns(spark):
    """Nulls, ties, repeated rows, long texts, absent bases, conversations that end turnless."""
    turns = [
        (3, None, "user", "a"), (3, 0, None, None), (3, 0, "", ""), (3, 1, "user", "b  c\td"), (3, 1, "user", "b  c\td"), (23, None, "user", "a"), (23, 5, "user", "z " * 40_000), (25, 1, "a", "b"), (27, 1, "a", "b"),
        (None, 1, "x", "y"), (40, 2, "u", "v"), (40, 1, "u", "w"), (41, 9, "q", "r"), (42, 9, "q", "r"), (43, 9, "q", "r"), (47, 9, "q", "r"), (53, 1, "ab", "c"), (54, 1, "a", "bc"), (2**62 + 1, 1, "u", "v"),
    ]
    got = check(spark, turns)
    with duckdb.connect() as con:
        columns = list(zip(*turns, strict=True))
        con.register("given", pd.DataFrame({"conv_id": pd.array(columns[0], "Int64"), "turn": pd.array(columns[1], "Int64"), "role": columns[2], "text": columns[3]}))
        con.execute("create view conversations as select * from given")
        assert rows(got) == rows(con.sql(trie.ORACLE).df())


def test_trees_of_many_depths(spark):
    """Random walks in a small tree, so that prefixes are shared at all depths; up to 40 turns."""
    r = random.Random(8)
    turns = [(c, t, "u" if t % 2 else "a", f"{r.randrange(2)} w") for c in range(300) for t in range(r.choice([1, 2, 3, 5, 8, 13, 21, 40]))]
    check(spark, turns, 5)


def test_hot_groups(spark):
    """A third of all turns in one conversation, and a third of all conversations alike."""
    long = [(7, t, "u", str(t % 5)) for t in range(900)]
    copies = [(100 + c, t, "u", f"same {t}") for c in range(300) for t in range(2)]
    check(spark, long + copies + [(c + 1000, 0, "u", str(c)) for c in range(300)], 6)


def test_chunks_of_ids_are_joined(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 210)
    check(spark, [(c, 0, "u", "same") for c in range(500)] + [(c, 1, "u", "more") for c in range(0, 500, 7)], 4)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = trie.trie(*trie.rebuilt(*trie.ordered(none)))
    assert got.count() == 0 and len(got.columns) == 8
    assert trie.trie(*trie.rebuilt(*trie.ordered(spark.createDataFrame([(None, 1, "a", "b")], none.schema)))).count() == 0
