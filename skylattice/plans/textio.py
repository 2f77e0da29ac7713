"""Text written and read back (operators A08 to A20 and B03 to B06) over the surrogate tables: each oracle is what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import configs, solutions, tables
from .registry import register
from .surrogate import STA, sta, table


@register("a19_solution_round_trip", f"WITH {STA} SELECT id, 1700000000 + id * 30 AS t, round(lat, 9) AS lat, round(lon, 9) AS lon, round(h, 4) AS height, CAST(id % 5 + 1 AS INT) AS quality FROM sta")
def solution_round_trip(spark, sf_dir) -> DataFrame:
    zero = F.lit(0.0)
    s = sta(spark, sf_dir).select((1700000000 + F.col("id") * 30).alias("t"), "lat", "lon", F.col("h").alias("height"), (F.col("id") % 5 + 1).cast("int").alias("quality"), F.lit(8).alias("ns"), *[F.lit(0.01).alias(c) for c in ("sdn", "sde", "sdu")], *[zero.alias(c) for c in ("sdne", "sdeu", "sdun", "age")], F.lit(9.9).alias("ratio"))
    got = solutions.parse(solutions.lines(s, "llh").select("line"), "line", "llh")
    t = F.round("t").cast("long")
    return got.select(((t - 1700000000) / 30).cast("long").alias("id"), t.alias("t"), "lat", "lon", "height", "quality")


@register("a14_config_tables", "SELECT replace(s_name, '#', '-') AS name, CAST(2000 + s_suppkey % 100 AS INT) AS port, 'M' || s_suppkey AS mountpoint FROM supplier")
def config_tables(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    line = F.concat_ws(",", F.regexp_replace("s_name", "#", "-"), F.lit("127.0.0.1"), (2000 + k % 100).cast("string"), F.lit("user"), F.lit("secret"), F.concat(F.lit("M"), k.cast("string")), F.lit("30.1"), F.lit("110.2"), F.lit("55.0#"))
    twice = table(spark, sf_dir, "supplier").select(k.alias("n"), line.alias("line"))
    twice = twice.unionAll(twice.select((F.col("n") + 1_000_000).alias("n"), F.regexp_replace("line", ",M", ",LATER"))).unionAll(twice.select("n", F.lit("short,line#")))
    return configs.parse(twice, "line", "sources", "n").select("name", "port", "mountpoint")


@register("a15_station_catalog", "SELECT n_name AS province, s_suppkey % 2 AS type, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def station_catalog(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    line = F.concat_ws(",", k.cast("string"), F.lit("road 1"), F.col("n_name"), F.lit("city"), F.lit("30.5"), F.lit("110.5"), F.lit("12.0"), F.lit("2014"), (k % 2).cast("string"))
    c = configs.parse(s.select(k.alias("n"), line.alias("line")), "line", "catalog", "n")
    return c.groupBy("province", F.col("type").cast("long").alias("type")).agg(F.count("*").alias("n"))


@register("a16_polygon_text", "SELECT r_name AS name, 4 AS n, 105e0 + r_regionkey AS x0, 29.5e0 AS y0 FROM region")
def polygon_text(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "region")
    at = lambda dx, dy: F.format_string("[%.6f,%.6f],", F.col("r_regionkey") + F.lit(105.0 + dx), F.lit(29.5 + dy))
    lines = r.select(F.col("r_name").alias("name"), F.posexplode(F.array(at(0, 0), at(1, 0), F.lit("noise"), at(1, 1), at(0, 1))).alias("i", "line"))
    p = tables.polygon(lines, "line", "i", "name")
    return p.select("name", F.size("ring").alias("n"), F.col("ring")[0]["x"].alias("x0"), F.col("ring")[0]["y"].alias("y0"))


@register("a10_correction_log", "SELECT event_id, CAST(2000 + event_id % 300 AS INT) AS week, event_id % 604800 AS tow, CAST(120 + event_id % 20 AS INT) AS prn, upper(md5(props)) AS head FROM events")
def correction_log(spark, sf_dir) -> DataFrame:
    """Messages written as lines and read back."""
    k = F.col("event_id")
    msg = F.unhex(F.concat(F.md5("props"), F.lpad(k.cast("string"), 26, "0")))
    m = table(spark, sf_dir, "events").select((2000 + k % 300).cast("int").alias("week"), (k % 604800).alias("tow"), (120 + k % 20).cast("int").alias("prn"), msg.alias("msg"))
    got = tables.correction_log(tables.correction_lines(m), "line")
    h = F.hex("msg")
    return got.select(F.substring(h, 33, 26).cast("long").alias("event_id"), "week", "tow", "prn", F.substring(h, 1, 32).alias("head"))


@register("a08_code_biases", "SELECT 'P1-P2' AS kind, 'G' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS sat, round(round(n_nationkey / 7e0 + 0.5, 3) * 0.299792458, 6) AS bias FROM nation")
def code_biases(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10).alias("i"), F.format_string("%-26s%9.3f", F.concat(F.lit("G"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")), F.col("n_nationkey") / 7e0 + 0.5).alias("line"))
    top = n.limit(1).select(F.lit(0).alias("i"), F.lit("DIFFERENTIAL (P1-P2) CODE BIASES FOR SATELLITES").alias("line"))
    return tables.code_biases(top.unionAll(n), "line", "i").select("kind", "sat", F.round("bias", 6).alias("bias"))


@register("a12_station_positions", f"WITH {STA} SELECT 'S' || id AS name, round(lat, 9) AS lat, round(lon, 9) AS lon, round(h, 4) AS height FROM sta")
def station_positions(spark, sf_dir) -> DataFrame:
    line = F.format_string("%.9f  %.9f %.4f S%d  %% note", "lat", "lon", "h", "id")
    return tables.station_positions(sta(spark, sf_dir).select(line.alias("line")), "line")


@register("a13_leap_seconds", "SELECT epoch_us(make_timestamp(2000 + n_nationkey, 1, 1, 0, 0, 0)) // 1000000 AS start, n_nationkey AS ahead FROM nation")
def leap_seconds(spark, sf_dir) -> DataFrame:
    line = F.format_string("%d 1 1 0 0 0 -%d # comment", F.col("n_nationkey") + 2000, F.col("n_nationkey"))
    return tables.leap_seconds(table(spark, sf_dir, "nation").select(line.alias("line")), "line")
