"""Streaming forms (operators H02, H07, H16), run to their end over the driver's tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import _delete, shared_dir
from ..streaming import processors
from .registry import register
from .surrogate import series, table


def _scratch(spark) -> str:
    """A folder for a stream's state and rows in the shared folder; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _events(spark, sf_dir) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


@register("h16_watermark_windows", "WITH w AS (SELECT user_id % 8 AS srcid, epoch_us(ts) // 3600000000 * 3600000000 AS start_us, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start_us + 3600000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)")
def watermark_windows(spark, sf_dir) -> DataFrame:
    """Hourly counts of windows that the watermark has closed."""
    e = _events(spark, sf_dir).select((F.col("user_id") % 8).alias("srcid"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "10 minutes")
    g = e.groupBy("srcid", F.window("ts", "1 hour").alias("w")).count()
    out = processors.run_to_table(g.select("srcid", F.unix_micros("w.start").alias("start_us"), F.col("count").alias("n")), _scratch(spark))
    return out.select("srcid", "start_us", "n")


@register("h07_throttle", """WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events), r AS (SELECT user_id, min(t) AS t FROM s GROUP BY 1 UNION ALL SELECT r.user_id, (SELECT min(s.t) FROM s WHERE s.user_id = r.user_id AND s.t - r.t >= 86400) AS t FROM r WHERE r.t IS NOT NULL)
SELECT user_id, round(t, 3) AS t FROM r WHERE t IS NOT NULL""")
def throttle(spark, sf_dir) -> DataFrame:
    x = series(spark, sf_dir).select("user_id", "t").distinct()
    return processors.throttled(x, "user_id", "t", 86400.0).select("user_id", F.round("t", 3).alias("t"))


@register("h07_throttle_stream", """WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events), r AS (SELECT user_id, min(t) AS t FROM s GROUP BY 1 UNION ALL SELECT r.user_id, (SELECT min(s.t) FROM s WHERE s.user_id = r.user_id AND s.t - r.t >= 86400) AS t FROM r WHERE r.t IS NOT NULL)
SELECT user_id, round(t, 3) AS t FROM r WHERE t IS NOT NULL""")
def throttle_stream(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", (F.expr("unix_micros(cast(ts as timestamp))") / 1e6).alias("t"))
    out = processors.run_to_table(processors.throttled(e, "user_id", "t", 86400.0), _scratch(spark))
    return out.select("user_id", F.round("t", 3).alias("t"))
