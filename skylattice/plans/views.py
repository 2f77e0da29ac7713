"""Read-side views and control tables (operators J01 to J09, and the batch forms of H01, H17, H18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import network
from .registry import register
from .surrogate import EPH, OBS, STA, eph, obs, sta, table


@register("h01_latest_epoch", f"WITH {OBS} SELECT srcid, sat, max(epoch) AS epoch, arg_max(p, epoch) AS p FROM obs GROUP BY 1, 2")
def latest_epoch(spark, sf_dir) -> DataFrame:
    return obs(spark, sf_dir).groupBy("srcid", "sat").agg(F.max("epoch").alias("epoch"), F.max_by("p", "epoch").alias("p"))


@register("h17_sessions", """WITH s AS (SELECT user_id, ts, sum(CASE WHEN ts - was < INTERVAL 12 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events))
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.unix_micros(F.min("ts")).alias("start_us"), F.unix_micros(F.max("ts")).alias("end_us"), F.count("*").alias("n"))
    return g.select("user_id", "start_us", "end_us", "n")


@register("h17_windows", "SELECT user_id % 8 AS srcid, epoch_us(ts) // 86400000000 * 86400000000 AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("srcid"), F.col("ts").cast("timestamp").alias("ts"), "value")
    g = e.groupBy("srcid", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("srcid", F.unix_micros("w.start").alias("start_us"), "n", "total")


@register("h18_solution_buffer", "SELECT c_nationkey AS srcid, c_custkey AS sol, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS slot FROM customer QUALIFY slot <= 10")
def solution_buffer(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("srcid").orderBy(F.desc("sol"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("srcid"), F.col("c_custkey").alias("sol"))
    return c.withColumn("slot", F.row_number().over(w).cast("long")).filter("slot <= 10")


@register("j01_navigation", f"WITH {EPH}, n AS (SELECT max(toe) AS now FROM eph) SELECT sat, iode, toe, iode % 3 = 0 AND abs(now - toe) <= 2592000 AS valid FROM eph, n")
def navigation(spark, sf_dir) -> DataFrame:
    x = eph(spark, sf_dir)
    now = x.agg(F.max("toe")).head()[0]
    return network.navigation(x.withColumn("svh", F.col("iode") % 3), now, 2592000.0).select("sat", "iode", "toe", "valid")


@register("j02_latest_observations", f"WITH {OBS}, m AS (SELECT srcid, max(epoch) AS epoch FROM obs GROUP BY srcid) SELECT s.s_name AS source, o.epoch, o.sat, o.p, o.snr FROM obs o JOIN m ON o.srcid = m.srcid AND o.epoch = m.epoch JOIN supplier s ON s.s_suppkey = o.srcid")
def latest_observations(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("srcid"), F.col("s_name").alias("source"))
    return network.latest(obs(spark, sf_dir), ["srcid"], "epoch").join(names, "srcid").select("source", "epoch", "sat", "p", "snr")


@register("j03_satellite_status", f"WITH {OBS}, m AS (SELECT *, row_number() OVER (PARTITION BY srcid, sat ORDER BY epoch DESC) AS k FROM obs) SELECT srcid, sat, el, CASE WHEN el >= 35 AND snr >= 35 THEN 'FIX' WHEN el >= 15 THEN 'FLOAT' ELSE '-' END AS status FROM m WHERE k = 1 AND el > 0")
def satellite_status(spark, sf_dir) -> DataFrame:
    last = obs(spark, sf_dir).groupBy("srcid", "sat").agg(F.max_by(F.struct("el", "snr"), "epoch").alias("_o")).select("srcid", "sat", "_o.*").filter("el > 0")
    return last.select("srcid", "sat", "el", F.when((F.col("el") >= 35) & (F.col("snr") >= 35), "FIX").when(F.col("el") >= 15, "FLOAT").otherwise("-").alias("status"))


@register("j04_source_info", f"WITH {STA} SELECT s.id, p.s_name AS name, round(s.lat, 4) AS lat, round(s.lon, 4) AS lon, n.n_name AS province FROM sta s JOIN supplier p ON p.s_suppkey = s.id LEFT JOIN nation n ON n.n_nationkey = p.s_nationkey")
def source_info(spark, sf_dir) -> DataFrame:
    s, p, n = sta(spark, sf_dir), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    x = s.join(p, s.id == p.s_suppkey).join(n, p.s_nationkey == n.n_nationkey, "left")
    return x.select("id", F.col("s_name").alias("name"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.col("n_name").alias("province"))


@register("j05_message_monitor", "WITH r AS (SELECT user_id AS srcid, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT srcid, event_type AS type, count(*) AS n FROM r WHERE k <= 32 GROUP BY 1, 2")
def message_monitor(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    r = table(spark, sf_dir, "events").withColumn("_k", F.row_number().over(w)).filter("_k <= 32")
    return r.groupBy(F.col("user_id").alias("srcid"), F.col("event_type").alias("type")).agg(F.count("*").alias("n"))


@register("j06_baseline_solutions", f"""WITH {STA}, b AS (SELECT b.id AS base, r.id AS rover, radians(b.lat) AS p, radians(b.lon) AS l, r.x - b.x AS dx, r.y - b.y AS dy, r.z - b.z AS dz FROM sta b JOIN sta r ON r.id = b.id + 1),
e AS (SELECT base, rover, -sin(l) * dx + cos(l) * dy AS e, -sin(p) * cos(l) * dx - sin(p) * sin(l) * dy + cos(p) * dz AS n, cos(p) * cos(l) * dx + cos(p) * sin(l) * dy + sin(p) * dz AS u FROM b)
SELECT base, rover, round(e, 3) AS e, round(n, 3) AS n, round(u, 3) AS u, round(sqrt(e * e + n * n + u * u), 3) AS length, round(degrees(asin(u / sqrt(e * e + n * n + u * u))), 6) AS pitch, round(degrees(CASE WHEN atan2(e, n) < 0 THEN atan2(e, n) + 2 * pi() ELSE atan2(e, n) END), 6) AS yaw FROM e""")
def baseline_solutions(spark, sf_dir) -> DataFrame:
    s = sta(spark, sf_dir)
    r = s.select((F.col("id") - 1).alias("base"), F.col("id").alias("rover"), *[F.col(c).alias(f"r{c}") for c in "xyz"])
    j = s.join(r, F.col("id") == F.col("base"))
    return network.baseline_views(j).select("base", "rover", *[F.round(c, 3).alias(c) for c in ("e", "n", "u", "length")], F.round("pitch", 6).alias("pitch"), F.round("yaw", 6).alias("yaw"))


@register("j08_control_tables", "SELECT s_name AS name, s_nationkey AS kind FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT c_name, c_nationkey FROM customer")
def control_tables(spark, sf_dir) -> DataFrame:
    """Sources with some deleted and some added."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    now = s.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("kind"))
    gone = s.filter("s_suppkey % 10 = 0").select(F.col("s_name").alias("name"))
    new = c.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("kind"))
    return network.apply_changes(now, new, gone, "name")
