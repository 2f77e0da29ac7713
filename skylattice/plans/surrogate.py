"""The driver's tables in the shapes of the domain, as DataFrames and, for the oracles, as SQL.

They hold no satellite data, so no result over them is a position. obs: observations from events; sta: stations from supplier; vsta: virtual
stations from customer; eph and req: ephemerides from orders and requests from lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy

#: Wavelength of the first frequency, m: c / 1575.42 MHz.
L1 = 0.190293672798365


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts: str) -> F.Column:
    return F.expr(f"unix_micros(cast({ts} as timestamp)) div 86400000000")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("srcid"), day("ts").alias("epoch"), (F.col("event_id") % 12 + 1).alias("sat"), "value")
    g = e.groupBy("srcid", "epoch", "sat").agg(F.round(F.avg("value") * L1, 6).alias("p"), F.round(F.max("value") * 0.7 + F.min("value") * 0.1, 6).alias("l"))
    return g.select("srcid", "epoch", "sat", (F.col("sat") % 4).alias("grp"), "p", "l", (5 + (F.col("sat") * 37 + F.col("epoch") * 11) % 85).alias("el"), (20 + (F.col("sat") * 7 + F.col("epoch") * 3) % 30).alias("snr"))


OBS = f"""e AS (SELECT user_id % 8 AS srcid, epoch_us(ts) // 86400000000 AS epoch, event_id % 12 + 1 AS sat, value FROM events),
g AS (SELECT srcid, epoch, sat, round(avg(value) * {L1}, 6) AS p, round(max(value) * 0.7 + min(value) * 0.1, 6) AS l FROM e GROUP BY 1, 2, 3),
obs AS (SELECT srcid, epoch, sat, sat % 4 AS grp, p, l, 5 + (sat * 37 + epoch * 11) % 85 AS el, 20 + (sat * 7 + epoch * 3) % 30 AS snr FROM g)"""


def _placed(df: DataFrame, key: str, a: int, b: int, height: str) -> DataFrame:
    lat, lon = F.lit(29e0) + (F.col(key) * a % 300) / F.lit(100e0), F.lit(105e0) + (F.col(key) * b % 400) / F.lit(100e0)
    x = df.select(F.col(key).alias("id"), lat.alias("lat"), lon.alias("lon"), (F.col(height) / 10e0).alias("h"))
    return x.withColumns(dict(zip("xyz", geodesy.ecef(F.radians("lat"), F.radians("lon"), F.col("h")), strict=True)))


def _placed_sql(name: str, source: str, key: str, a: int, b: int, height: str) -> str:
    v = "6378137e0 / sqrt(1 - e2 * sin(radians(lat)) * sin(radians(lat)))"
    return f"""{name}0 AS (SELECT {key} AS id, 29e0 + ({key} * {a} % 300) / 100e0 AS lat, 105e0 + ({key} * {b} % 400) / 100e0 AS lon, {height} / 10e0 AS h, (2 - 1 / 298.257223563e0) / 298.257223563e0 AS e2 FROM {source}),
{name} AS (SELECT id, lat, lon, h, ({v} + h) * cos(radians(lat)) * cos(radians(lon)) AS x, ({v} + h) * cos(radians(lat)) * sin(radians(lon)) AS y, ({v} * (1 - e2) + h) * sin(radians(lat)) AS z FROM {name}0)"""


def sta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(table(spark, sf_dir, "supplier"), "s_suppkey", 37, 73, "s_acctbal")


def vsta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(table(spark, sf_dir, "customer"), "c_custkey", 53, 91, "c_acctbal")


STA = _placed_sql("sta", "supplier", "s_suppkey", 37, 73, "s_acctbal")
VSTA = _placed_sql("vsta", "customer", "c_custkey", 53, 91, "c_acctbal")


def eph(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 32 + 1).alias("sat"), F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000").alias("toe"), F.col("o_orderkey").alias("iode"))


def req(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem")
    return r.select((F.col("l_suppkey") % 32 + 1).alias("sat"), F.expr("unix_micros(cast(l_shipdate as timestamp)) div 1000000").alias("t")).distinct()


EPH = """eph AS (SELECT o_custkey % 32 + 1 AS sat, epoch_us(o_orderdate) // 1000000 AS toe, o_orderkey AS iode FROM orders),
req AS (SELECT DISTINCT l_suppkey % 32 + 1 AS sat, epoch_us(l_shipdate) // 1000000 AS t FROM lineitem)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase series: user_id and event_type as the link, t in seconds, value as phase."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_type", "event_id", (F.expr("unix_micros(cast(ts as timestamp))") / 1e6).alias("t"), "value")


SERIES = "series AS (SELECT user_id, event_type, event_id, epoch_us(ts) / 1e6 AS t, value FROM events)"
