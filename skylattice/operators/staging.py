"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import math
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that shuffle files go with the query that wrote them, not when the driver's memory is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of staged tables, a list for each passing() that is open.
_passing: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a default if driver and executors are one process, else an error, as a folder of each
    machine's own would lose rows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints/skylattice").rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder is the cluster's to clear
        pass


def staged(df: DataFrame) -> DataFrame:
    """Write df and read it again: a loop's next round doesn't compute the former ones anew, and a lost executor loses nothing. The
    table goes when the driver's Python ends, or before with the passing() around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    if _passing:
        _passing[-1].append(path)
    else:
        atexit.register(_delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside go at its end, shuffle files inside with the write that made them."""
    was = spark.conf.get(CLEANUP)
    _passing.append([])
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)
        for path in _passing.pop():
            _delete(spark, path)


def in_turn(rows: DataFrame, key: str, most: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work's results over all rows, in parts of about `most` rows one after another, so that the disk holds the steps of one part and the results so
    far. Rows of a key, null among them, are in one part; work must not need those of other keys."""
    spark = rows.sparkSession
    parts = max(1, math.ceil(rows.count() / most))
    base, schema = f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}", None
    atexit.register(_delete, spark, base)
    for k in range(parts):
        with passing(spark):
            got = work(rows.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k))
            got.write.parquet(f"{base}/{k}")
            schema = got.schema
    return spark.read.schema(schema).parquet(*[f"{base}/{k}" for k in range(parts)])
