r"""Importance resampling of documents towards the distribution of target texts, in DataFrame functions only.

Words are runs of digits, letters a to z (A to Z lower-cased, nothing else) and characters from U+0080 on. Features are all runs of one and
two consecutive words; a feature's bucket is crc32 modulo BUCKETS. A bucket's gain is the smoothed log ratio of its shares in the target and
in the documents, in thousandths; a document's weight is the mean gain of its features. A Gumbel number of the document's id added to the
weight makes the highest scores a weighted draw without replacement.

The buckets of each document's features are written once as arrays; these are exploded to count buckets and again to join the gain
table (BUCKETS rows, broadcast) and sum by document. Ranks come from a distributed sort: place in the partition plus the
partition's offset.

Defined cases. Null and empty texts: no features, weight 0; they never reach `least` words. Very long texts are read whole, as one row each. A null doc_id counts as the
empty text in the draw and comes last among ties. Repeated rows: each is a document and counts by itself; rows of equal score and doc_id are
ordered by text hash and are otherwise interchangeable. Columns besides doc_id and text aren't read by `weighted`; `draw`
returns them all, whatever their names. Empty documents: an empty result. No target texts: gains are those of empty counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE, a_to_z, crc_sql, numbered, staged, table

#: A word (fixed pattern), in text whose A to Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Percent of the documents with at least LEAST words that are drawn.
SHARE, LEAST = 25, 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(a_to_z(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def ngrams(w: Column) -> Column:
    """Runs of one word, then runs of two."""
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(w, pairs)


def buckets(features: Column) -> Column:
    return F.transform(features, lambda x: (F.crc32(x) % BUCKETS).cast("int"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number that depends on the id alone."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def bucket_counts(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("_buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain, for all BUCKETS buckets; both sides have _buckets."""
    every = Window.partitionBy()  # BUCKETS rows
    x = documents.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    x = x.join(bucket_counts(documents).withColumnRenamed("n", "s"), "bucket", "left").join(bucket_counts(target).withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    x = x.select("bucket", s.alias("s"), t.alias("t"), F.sum(s).over(every).alias("all_s"), F.sum(t).over(every).alias("all_t"))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + float(BUCKETS)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(BUCKETS)))
    return staged(x.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain")))


def featured(docs: DataFrame, carry: bool) -> DataFrame:
    """A written row for each document: _rid, doc_id, n_words, n_features, _hash, _buckets; with carry also _row, all its columns."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    x = docs.select("doc_id", words(F.col("text")).alias("_w"), F.xxhash64("text").alias("_hash"), *row)
    x = x.select("doc_id", "_hash", F.size("_w").cast("long").alias("n_words"), buckets(ngrams(F.col("_w"))).alias("_buckets"), *(["_row"] if carry else []))
    return staged(x.select(F.monotonically_increasing_id().alias("_rid"), "*", F.size("_buckets").cast("long").alias("n_features")))


def weighed(light: DataFrame, gain: DataFrame) -> DataFrame:
    """light's rows with weight, the floored mean of their buckets' gains."""
    keys = ["_rid", "doc_id", "_hash", "n_words", "n_features"]
    x = light.select(*keys, F.explode_outer("_buckets").alias("bucket")).join(F.broadcast(gain), "bucket", "left")
    g, n = F.coalesce(F.sum("gain"), F.lit(0)), F.greatest(F.col("n_features"), F.lit(1))
    x = x.groupBy(*keys).agg(g.alias("_g"))
    return x.withColumn("_n", n).withColumn("weight", F.expr("(_g - pmod(_g, _n)) div _n")).drop("_g", "_n")


def ranked(docs: DataFrame, target: DataFrame, seed: int = 7, share: int = SHARE, least: int = LEAST, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents as featured() writes them, doc_id, _rid, n_words, n_features, weight, score and rank; rank is null for those not drawn)."""
    light = featured(docs, carry)
    gain = gains(light, target.select(buckets(ngrams(words(F.col("text")))).alias("_buckets")))
    x = weighed(light, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    x = staged(x)
    drawn = x.filter(F.col("n_words") >= least).count() * share // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_hash"), F.col("_rid")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    high = numbered(x.filter(F.col("n_words") >= least).repartitionByRange(parts, *order).sortWithinPartitions(*order), "_at")
    rank = F.when(F.col("_at") < drawn, F.col("_at") + 1)
    some = ["_rid", "doc_id", "n_words", "n_features", "weight", "score"]
    low = x.filter(F.col("n_words") < least).select(*some, F.lit(None).cast("long").alias("rank"))
    return light, high.select(*some, rank.alias("rank")).unionAll(low)


def weighted(docs: DataFrame, target: DataFrame, seed: int = 7, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score, rank."""
    return ranked(docs, target, seed, share, least)[1].drop("_rid")


def draw(docs: DataFrame, target: DataFrame, seed: int = 7, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """The drawn documents with all their columns."""
    light, got = ranked(docs, target, seed, share, least, carry=True)
    return light.select("_rid", "_row").join(got.filter("rank IS NOT NULL").select("_rid"), "_rid").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    got = weighted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
u AS MATERIALIZED (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
c AS MATERIALIZED (SELECT f, {crc_sql("f")} % 10000 AS k FROM u, crc),
s AS (SELECT k, count(*) AS s FROM df JOIN c USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bf JOIN c USING (f) GROUP BY k),
n AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM df) AS ns, (SELECT CAST(count(*) AS DOUBLE) FROM bf) AS nt),
g AS (SELECT k, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (ns + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (nt + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (k), n),
x AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n_features FROM df JOIN c USING (f) JOIN g USING (k) GROUP BY rid),
y AS (SELECT d.rid, doc_id, text, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
             coalesce(total // n_features - CASE WHEN total % n_features < 0 THEN 1 ELSE 0 END, 0) AS weight,
             CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN x USING (rid)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS pos FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND pos <= 25 * (SELECT count(*) FROM z WHERE n_words >= 20) // 100 THEN pos END AS rank FROM r
"""
