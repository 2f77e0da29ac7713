"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word everywhere in this subpackage (fixed pattern).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a default if driver and executors are one
    process, else an error, as a folder of each machine's own would lose rows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints/skylattice").rstrip("/")


#: Rows and MB of an Arrow batch at most. Spark's own limits (10,000 rows, 64 MB) let each task of a text operator hold hundreds of MB in
#: buffers, strings and results on both sides.
BATCH_ROWS, BATCH_MB = 2000, 4


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches to these; they are read when a plan is made, so they stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_MB << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder is the cluster's to clear
        pass


def delete_at_end(spark: SparkSession, path: str) -> None:
    atexit.register(_delete, spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    _delete(spark, path)


def staged(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and a lost executor loses
    nothing. The table goes when the driver's Python ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str) -> DataFrame:
    """df, staged, with column: 0, 1, 2... in the order of its partitions and of the rows in each: the place in the partition plus the
    partition's offset. The offsets are a row for each partition."""
    x = staged(df.withColumn(column, F.monotonically_increasing_id()))
    part = F.shiftright(column, 33).alias("_part")
    n = x.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = n.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    x = x.join(F.broadcast(first), part == F.col("_of"))
    return x.withColumn(column, F.col("_first") + F.col(column).bitwiseAND(F.lit((1 << 33) - 1))).drop("_of", "_first")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def a_to_z(text: Column) -> Column:
    """text with A to Z lower-cased and nothing else; texts of ASCII alone take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def by_document(docs: DataFrame, run: Callable, schema: str) -> DataFrame:
    """docs' doc_id and text through run, whose result has doc_id first. Ids travel as text, since a batch that holds a null would
    turn them into floating-point numbers."""
    small_batches(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").cast("string"), "text").mapInPandas(run, schema.replace("doc_id long", "doc_id string", 1))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def release(spark: SparkSession) -> None:
    """Have the driver collect plans that nothing refers to any more: executors then delete the shuffle files of steps whose results
    are staged. Without it they stay until the driver's memory happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A sampled id that stands for more documents than this isn't learnt from.
MOST_COPIES = 8


def seldom(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of the (few, distinct) ids that docs holds at most MOST_COPIES times: a sample by id stays bounded when one id is
    on a large share of all rows. Counts combine before the shuffle."""
    n = docs.select("doc_id").join(F.broadcast(ids), "doc_id").groupBy("doc_id").count()
    return n.filter(F.col("count") <= MOST_COPIES).select("doc_id")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def held_out(doc_id: Column) -> Column:
    """The documented fold: crc32 of the id's decimal text, modulo 5, is 0. A null id counts as the empty text, whose
    crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


#: crc32 by bytes in SQL: its table by rule, and a fold over the bytes of x (an expression of text).
CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i))"


def crc_sql(x: str) -> str:
    pairs = f"list_transform(range(octet_length(encode({x}))), lambda i: CAST('0x' || substr(hex(encode({x})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({pairs}, lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1]), 4294967295), 4294967295)"
