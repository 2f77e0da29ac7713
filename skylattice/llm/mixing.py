"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time: the words its source has sent up to and with it, divided by the
source's target. All copies are ordered by that time and the order is cut at the total budget. Everything is DataFrame
code; the driver sees two histograms of fixed length and one cut position.

Defined cases. Columns besides doc_id, source and text, whatever their names, pass through. Very long texts: never cut, so a source may end
a document off its target. Ties: documents of one id and size are told apart by their texts' hashes, so reruns take the same ones.
Null text: size 0, never more than 0 words taken. Null source: a source of its own, last. Null doc_id: a
document like any other, its id counts as the empty text in the shuffle. Many texts of one id are shuffled like texts of many ids. Repeated rows: each is a document; equal rows
are interchangeable and stand side by side in the queue. An empty table gives an empty result. A source whose size is 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, staged

#: Most copies of a document, and so most of a source's target in its sizes.
MOST = 3
#: Documents in one bucket of the running sums, on average.
BUCKET_ROWS = 2048
BINS = 4096
#: So many sources at most are sent to all executors, a hundred bytes each; more are joined by a shuffle.
FEW_SOURCES = 20_000


def shuffle_key(doc_id: Column, text: Column, seed: int) -> Column:
    """60 uniform bits that depend on the id and the text alone, so that the documents of one id are spread like others."""
    told = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, rank, n_docs, source_size, target. Weights 1, 2, 3, repeating by rank; a target stops at MOST times the
    source's size and what is above is shared again by weight. That is a water level L with
    target = least(MOST * size, weight * L); L is the largest of the levels that arise as sources, taken by
    MOST * size / weight, fill up. One row per source, so its windows run over the sources only."""
    every = Window.partitionBy()
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("_full", "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    t = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    t = t.withColumn("rank", F.row_number().over(by_rank)).withColumn("_w", (F.col("rank") - 1) % 3 + 1)
    t = t.withColumn("_full", (MOST * F.col("source_size")).cast("double") / F.col("_w"))
    spent = F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0))
    weights = F.coalesce(F.sum("_w").over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - spent).cast("double") / (F.sum("_w").over(every) - weights)
    t = t.withColumn("_level", level).withColumn("_level", F.max("_level").over(every))
    target = F.least((MOST * F.col("source_size")).cast("double"), F.col("_w") * F.col("_level"))
    return t.select("source", "rank", "n_docs", "source_size", target.alias("target"))


def _queued(docs: DataFrame, seed: int, carry: bool) -> DataFrame:
    """Each document with its source's figures and `_sent`, the words its source has sent when it ends. Running sums
    are made in buckets of about BUCKET_ROWS documents by shuffle key, so that a hot source or a hot id is spread over many tasks."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    x = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text"), seed).alias("_key"), F.xxhash64("text").alias("_hash"), *row)
    if not carry:
        x = staged(x)  # words are counted once
    s = staged(source_targets(x.select("source", "size")).withColumnRenamed("source", "_of"))
    if s.count() <= FEW_SOURCES:
        s = F.broadcast(s)
    x = x.join(s, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    parts = F.ceil(F.col("n_docs") / BUCKET_ROWS).cast("long")
    x = x.withColumn("_b", F.shiftright(F.shiftright("_key", 30) * parts, 30))
    sums = x.groupBy("rank", "_b").agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("rank", "_b").orderBy("_key", "doc_id", "size", "_hash").rowsBetween(Window.unboundedPreceding, 0)
    return x.join(sums, ["rank", "_b"]).withColumn("_sent", F.col("_before") + F.sum("size").over(inside))


def _finish(epoch: Column) -> Column:
    sent = (epoch * F.col("source_size") + F.col("_sent")).cast("double")
    return F.when(F.col("target") > 0, sent / F.col("target")).otherwise(F.lit(0.0))


def _bin(finish: Column) -> Column:
    """Order-preserving number of finish's bin among BINS * BINS."""
    g = finish / (1 + finish) * BINS
    return (F.floor(g) * BINS + F.floor((g - F.floor(g)) * BINS)).cast("long")


def _crossing(bins: DataFrame, column: str, spent: int, budget: int) -> tuple[int | None, int]:
    """The first bin whose end passes the budget, and the words before it; bins has BINS rows at most."""
    upto = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    row = bins.withColumn("_upto", F.sum("_words").over(upto) + spent).filter(F.col("_upto") > budget).orderBy(column).select(column, F.col("_upto") - F.col("_words")).head()
    return (row[0], row[1]) if row else (None, 0)


def mix(docs: DataFrame, seed: int = 7, budget: int | None = None, carry: bool = False) -> DataFrame:
    """Every document with size, source_size, target, copies and taken (= copies * size); with carry also `_row`, the
    document's own columns. budget: total words, all sizes by default (then targets sum to it)."""
    light = staged(_queued(docs, seed, False))
    if budget is None:
        budget = light.agg(F.sum("size")).head()[0] or 0
    epochs = F.array(*[F.lit(e).cast("long") for e in range(MOST)])
    copies = light.filter("size > 0").withColumn("_e", F.explode(epochs)).withColumn("_f", _finish(F.col("_e"))).withColumn("_bin", _bin(F.col("_f")))
    first = copies.groupBy(F.shiftright("_bin", 12).alias("_hi")).agg(F.sum("size").alias("_words"))
    hi, spent = _crossing(first, "_hi", 0, budget)
    order = ["_f", "rank", "_key", "doc_id", "size", "_e"]
    cut_bin, cut = None, None
    if hi is not None:
        edge = copies.filter(F.shiftright("_bin", 12) == hi)
        cut_bin, spent = _crossing(edge.groupBy("_bin").agg(F.sum("size").alias("_words")), "_bin", spent, budget)
        running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        last = edge.filter(F.col("_bin") == cut_bin).withColumn("_upto", F.sum("size").over(running) + spent)
        cut = last.filter(F.col("_upto") <= budget).orderBy(*[F.col(c).desc() for c in order]).select(*order).head()

    def taken(e: Column) -> Column:
        f = _finish(e)
        if cut_bin is None:
            return F.lit(True)
        at = _bin(f)
        if cut is None:
            return at < cut_bin
        own = F.struct(f, F.col("rank"), F.col("_key"), F.col("doc_id"), F.col("size"), e)
        kinds = dict(light.withColumn("_e", F.lit(0).cast("long")).withColumn("_f", F.lit(0.0)).select(*order).dtypes)
        to = F.struct(*[F.lit(v).cast(kinds[k]) for k, v in zip(order, cut, strict=True)])
        return (at < cut_bin) | ((at == cut_bin) & (own <= to))

    heavy = _queued(docs, seed, True) if carry else light
    n = F.when(F.col("size") > 0, sum(taken(F.lit(e).cast("long")).cast("long") for e in range(MOST))).otherwise(F.lit(1).cast("long"))
    kept = ["doc_id", "size", "source_size", "target", "copies", *(["_row"] if carry else [])]
    return heavy.withColumn("copies", n).select(*kept).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix as documents: a document is repeated as often as it is taken. Documents without words stay once."""
    m = mix(docs, seed, carry=True).filter("copies > 0")
    return m.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS k
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM sized GROUP BY source),
w AS (SELECT *, (rnk - 1) % 3 + 1 AS wt, CAST(3 * source_size AS DOUBLE) / ((rnk - 1) % 3 + 1) AS full_at FROM src),
lev AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER f, 0) AS DOUBLE) / (sum(wt) OVER () - coalesce(sum(wt) OVER f, 0)) AS lv
  FROM w WINDOW f AS (ORDER BY full_at, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT source, source_size, rnk, least(CAST(3 * source_size AS DOUBLE), wt * max(lv) OVER ()) AS target FROM lev),
q AS (SELECT s.doc_id, s.size, s.k, t.source_size, t.rnk, t.target,
         CAST(sum(s.size) OVER (PARTITION BY t.rnk ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sent
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e, CASE WHEN target > 0 THEN CAST(e * source_size + sent AS DOUBLE) / target ELSE 0 END AS f FROM q, (SELECT unnest([0, 1, 2]) AS e)),
r AS (SELECT *, sum(size) OVER (ORDER BY f, rnk, k, doc_id, size, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= (SELECT sum(size) FROM sized) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM r GROUP BY doc_id, size, source_size, target, rnk, k, sent
"""
