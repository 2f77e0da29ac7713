"""Prefix trie of conversations by prefix doubling.

Turns get dense names by their content. Aligned blocks of 2, 4, 8... turns are named in as many rounds: a block is the pair of its halves'
names, and equal pairs get one dense name. A prefix of d turns is composed from aligned blocks along the binary digits of d: the prefix
without its last block, which has fewer digits, and that block's name. So names of prefixes take one more round for each further digit,
and a node of the trie is a depth and a prefix's name. Sums over subtrees go up by doubling too: in round k each node's sums of the
descendants less than 2**k below are added to its ancestor 2**k above, and ancestors are composed. All is
in proportion to turns times the logarithm of the longest conversation; nothing grows with the square of a conversation's length or with a
group's pairs.

Every round is a written table of numbers; texts are read once, for their digests and words, and aren't shuffled. A conversation's turns
are put in order by a range sort of all turns, so that a long one is spread; names of hot turns and blocks are found by joins with tables
of one row a name, which adaptive execution can split; counts combine before they are shuffled. The hash of a node's members is a stream
of bytes by its definition: ids are sorted by range and joined to chunks in many tasks, and one task reads a node's chunks one by one.

Defined cases. Null role or text: as if empty. Null turn: before all others; ties of turn go by role, the text's first 64 characters and
its digest. Repeated rows are turns like others. Null conv_id: no conversation, left out. Very long texts are read whole. Columns besides conv_id, turn, role
and text aren't read, whatever their names. Empty table: no conversation, so not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE, crc_sql, n_words, numbered, staged, table

#: A conversation takes its first turns from the conversation with the next lower multiple of GROUP, MOST - 1 of them at most.
GROUP, MOST = 20, 4
#: Characters of a chunk of ids.
CHUNK = 1 << 16


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: c, i from 0, key, words; conversations: c, n). The place of a turn is its place in a range sort of all turns less that of its
    conversation's first turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    x = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("key"), n_words(text).alias("words"))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("key")]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("c", "key", "words")
    x = staged(numbered(x, "at"))
    convs = staged(x.groupBy("c").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    return x.join(convs.select("c", "first"), "c").select("c", (F.col("at") - F.col("first")).alias("i"), "key", "words"), convs.select("c", "n")


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (c, i, key, words, n) and conversations (c, n) in which each conversation c has the first h turns of c - c % GROUP in the
    place of its own first h, h = crc32(c) % MOST."""
    h = F.crc32(F.col("c").cast("string")) % MOST
    base = convs.select(F.col("c").alias("base"), F.col("n").alias("nb"))
    plan = convs.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % GROUP).alias("base")).join(base, "base", "left")
    plan = plan.withColumn("head", F.least("h", F.coalesce("nb", F.lit(0))))
    plan = staged(plan.select("c", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    own = turns.join(plan.select("c", "h", "head", "n"), "c").filter("i >= h").select("c", (F.col("i") - F.col("h") + F.col("head")).alias("i"), "key", "words", "n")
    heads = turns.filter((F.col("c") % GROUP == 0) & (F.col("i") < MOST - 1)).withColumnRenamed("c", "base")
    taken = plan.filter("head > 0").select("c", "base", "head", "n").join(heads, "base").filter("i < head").select("c", "i", "key", "words", "n")
    return staged(own.unionAll(taken)), plan.select("c", "n")


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, staged, with name, a dense number of its distinct keys."""
    names = staged(numbered(rows.select(*keys).distinct(), "name"))
    return rows.join(names, keys)


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """c, d, name, n: the name, dense at each depth, of each conversation's first d turns; longest is the number of the longest's turns."""
    blocks = staged(named(turns.select("c", F.col("i").alias("j"), "key", "n"), ["key"]).select("c", "j", "name", "n"))
    ends, k = [], 0
    while True:
        # the even blocks of a level are the last blocks of the prefixes that end with them
        ends.append(blocks.filter("j % 2 = 0").select("c", ((F.col("j") + 1) * (1 << k)).alias("d"), (F.col("j") * (1 << k)).alias("before"), "name", "n", (F.expr("bit_count(j)") + 1).alias("digits")))
        k += 1
        if longest >> k == 0:
            break
        half = lambda odd: blocks.filter(F.col("j") % 2 == odd).select("c", F.shiftright("j", 1).alias("j"), F.col("name").alias(f"_{odd}"), *([] if odd else ["n"]))  # noqa: B023, E731
        blocks = staged(named(staged(half(0).join(half(1), ["c", "j"])), ["_0", "_1"]).select("c", "j", "name", "n"))
    every = ends[0]
    for x in ends[1:]:
        every = every.unionAll(x)
    one = last = every.filter("digits = 1").select("c", "d", "name", "n")
    found = one
    for digits in range(2, longest.bit_length() + 1):
        rows = every.filter(F.col("digits") == digits).select("c", "d", "before", F.col("name").alias("block"), "n")
        rows = staged(rows.join(last.select("c", F.col("d").alias("before"), F.col("name").alias("start")), ["c", "before"]))
        last = staged(named(rows, ["d", "start", "block"]).select("c", "d", "name", "n"))
        found = found.unionAll(last)
    return staged(found)


def _hashes(members: DataFrame) -> DataFrame:
    """d, name, ends: the SHA-256 of the members' ids, ascending, comma-joined. members: d, name, c."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = CHUNK // 21  # an id has 20 characters at most
        for pdf in batches:
            new = (pdf["d"].diff().ne(0) | pdf["name"].diff().ne(0)).cumsum()
            at = pdf.groupby(new).cumcount() // most
            g = pdf.assign(ids=pdf["c"].astype(str)).groupby([new, at], sort=False)
            yield g.agg(d=("d", "first"), name=("name", "first"), first=("c", "first"), ids=("ids", ",".join)).reset_index(drop=True)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for pdf in batches:
            out = []
            for d, name, ids in zip(pdf["d"], pdf["name"], pdf["ids"], strict=True):
                if (d, name) != key:
                    if sha:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (d, name), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["d", "name", "ends"])
        if sha:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=["d", "name", "ends"])

    x = members.repartitionByRange(parts, "d", "name", "c").sortWithinPartitions("d", "name", "c").mapInPandas(chunks, "d long, name long, first long, ids string")
    return x.repartition("d", "name").sortWithinPartitions("d", "name", "first").mapInPandas(digests, "d long, name long, ends string")


def _ancestors(v: DataFrame, step: int) -> DataFrame:
    """v (conv_id, depth, up: the ancestor `step` above) with up2, that of the ancestor."""
    a = v.filter(F.col("depth") >= step).select(F.col("conv_id").alias("up"), F.col("depth").alias("_d"), F.col("up").alias("up2"))
    return v.withColumn("_d", F.col("depth") - step).join(a, ["up", "_d"], "left").drop("_d")


def subtree_sums(nodes: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """nodes (conv_id, depth, parent, and numbers) with each of sums added up over the node's subtree. The rounds are staged."""
    v = nodes.select("conv_id", "depth", F.col("parent").alias("up"), *sums)
    step = 1
    while step <= deepest:
        below = v.filter(F.col("depth") >= step).groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        v = _ancestors(v, step).join(below, ["conv_id", "depth"], "left")
        v = staged(v.select("conv_id", "depth", F.col("up2").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]))
        step *= 2
    return v.drop("up")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes. turns: c, i (0, 1, 2... in each conversation), key (equal for equal turns), words, n (turns of c); convs: c, n, with
    those that have no turns. Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    root, all_convs, longest = convs.agg(F.min("c"), F.count("*"), F.max("n")).head()
    spark = convs.sparkSession
    kinds = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not all_convs:
        return spark.createDataFrame([], kinds)
    none = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0).cast("long")
    m = prefixes(turns, longest) if longest else turns.select("c", zero.alias("d"), zero.alias("name"), "n")
    ends = m.filter("d = n").select("d", "name", "c").unionAll(convs.filter("n = 0").select(zero.alias("d"), zero.alias("name"), "c"))
    groups = staged(m.groupBy("d", "name").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")))
    first = groups.join(turns.select(F.col("c").alias("conv_id"), (F.col("i") + 1).alias("d"), "words"), ["conv_id", "d"])
    above = m.select(F.col("c").alias("conv_id"), (F.col("d") + 1).alias("d"), F.col("name").alias("pname"))
    parents = groups.select((F.col("d") + 1).alias("d"), F.col("name").alias("pname"), F.col("conv_id").alias("_parent"))
    nodes = first.join(above, ["conv_id", "d"], "left").join(parents, ["d", "pname"], "left")
    nodes = nodes.select("conv_id", F.col("d").alias("depth"), "name", F.when(F.col("d") == 1, F.lit(root)).otherwise(F.col("_parent")).alias("parent"), "n_convs", "words")
    top = spark.range(1).select(F.lit(root).cast("long").alias("conv_id"), zero.alias("depth"), zero.alias("name"), F.lit(None).cast("long").alias("parent"), F.lit(all_convs).cast("long").alias("n_convs"), zero.alias("words"))
    nodes = staged(nodes.unionAll(top))
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select("conv_id", "depth", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    x = nodes.join(subtree_sums(own, ["n_leaves", "saved_tokens"], longest), ["conv_id", "depth"]).join(_hashes(ends).withColumnRenamed("d", "depth"), ["depth", "name"], "left")
    return x.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(none)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = ordered(table(spark, sf_dir, "conversations"))
    return trie(*rebuilt(turns, convs))


ORACLE = rf"""
WITH {CRC_TABLE},
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), substr(coalesce(text, ''), 1, 64), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
      FROM conversations WHERE conv_id IS NOT NULL),
cv AS (SELECT c, count(*) AS n, {crc_sql("CAST(c AS VARCHAR)")} % 4 AS h, c - c % 20 AS base FROM t, crc GROUP BY c, tab),
pl AS (SELECT x.*, least(x.h, coalesce(b.n, 0)) AS head FROM cv x LEFT JOIN cv b ON x.base = b.c),
r AS MATERIALIZED (SELECT t.c, i - h + head + 1 AS d, role, text FROM t JOIN pl USING (c) WHERE i >= h
      UNION ALL SELECT pl.c, i + 1, role, text FROM pl JOIN t ON t.c = pl.base AND t.i < pl.head),
p AS MATERIALIZED (SELECT c, d, text, sha256(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM r
      UNION ALL SELECT c, 0, '', '' FROM pl),
l AS (SELECT c, max(d) AS n FROM p GROUP BY c),
nd AS MATERIALIZED (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, min(CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT)) AS words,
        coalesce(string_agg(CASE WHEN d = n THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ids FROM p JOIN l USING (c) GROUP BY d, k),
up AS MATERIALIZED (SELECT DISTINCT a.d, a.k, b.d AS pd, b.k AS pk FROM p a JOIN p b ON a.c = b.c AND b.d <= a.d),
ch AS (SELECT pd AS d, pk AS k, count(*) AS n_children FROM up WHERE d = pd + 1 GROUP BY pd, pk),
f AS (SELECT nd.*, coalesce(n_children, 0) AS n_children FROM nd LEFT JOIN ch USING (d, k)),
su AS (SELECT pd AS d, pk AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM up JOIN f USING (d, k) GROUP BY pd, pk),
pa AS (SELECT up.d, up.k, nd.conv_id AS parent FROM up JOIN nd ON nd.d = up.pd AND nd.k = up.pk WHERE up.d = up.pd + 1)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ids) AS ends_sha256
FROM f JOIN su USING (d, k) LEFT JOIN pa USING (d, k)
"""
