"""Files of the domain written and read back inside tasks (operators A01 to A07, B01, B02, B07, B08), and augmentation delays (G15): each oracle is
what must come back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import augmentation
from ..operators import spatial
from ..sources import combine, grids, rinex
from ..streaming import processors
from .registry import register
from .surrogate import EPH, OBS, STA, VSTA, eph, obs, sta, table, vsta


@register("a01_observation_file", f"WITH {OBS} SELECT srcid, epoch * 86400 AS t, 'G' || lpad(CAST(sat AS VARCHAR), 2, '0') AS sat, round(p * 1.2345678e0 + 100, 3) AS value, CAST(sat % 4 AS INT) AS lli FROM obs")
def observation_file(spark, sf_dir) -> DataFrame:
    """A file for each source."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(float(e) * 86400, f"G{s:02d}", "C1C", p * 1.2345678 + 100, int(s) % 4, 7) for e, s, p in zip(pdf["epoch"], pdf["sat"], pdf["p"], strict=True)]
        got = rinex.observations(rinex.write_observations(rows))
        return pd.DataFrame([(pdf["srcid"].iloc[0], int(t), s, v, f) for t, s, _, v, f, _ in got], columns=["srcid", "t", "sat", "value", "lli"])

    return obs(spark, sf_dir).select("srcid", "epoch", "sat", "p").groupBy("srcid").applyInPandas(run, "srcid long, t long, sat string, value double, lli int")


#: Issues that the files of all satellites of one range have, at most.
ISSUES = 200_000


@register("a03_navigation_file", f"WITH {EPH} SELECT 'G' || lpad(CAST(sat AS VARCHAR), 2, '0') AS sat, toe AS toc, iode, round(iode / 7e0, 6) AS crs, true AS exact FROM eph")
def navigation_file(spark, sf_dir) -> DataFrame:
    """Files of a satellite by range of issues, so that none grows with the table; numbers keep thirteen digits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = [{"sat": f"G{s:02d}", "toc": float(t), "iode": float(i), "crs": i / 7, "m0": -1.2345678901e-9 * i} for s, t, i in zip(pdf["sat"], pdf["toe"], pdf["iode"], strict=True)]
        got = list(rinex.navigation(rinex.write_navigation(e)))
        exact = np.isclose([g["m0"] for g in got], [w["m0"] for w in e], rtol=1e-12).tolist()
        rows = [(g["sat"], int(g["toc"]), int(g["iode"]), round(g["crs"], 6), same) for g, same in zip(got, exact, strict=True)]
        return pd.DataFrame(rows, columns=["sat", "toc", "iode", "crs", "exact"])

    return eph(spark, sf_dir).groupBy("sat", F.floor(F.col("iode") / ISSUES)).applyInPandas(run, "sat string, toc long, iode long, crs double, exact boolean")


@register("a04_clock_combination", "SELECT l_orderkey AS t, arg_max(l_discount, {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_extendedprice, 'e': l_discount}) FILTER (l_discount <> 0) AS clock FROM lineitem GROUP BY 1")
def clock_combination(spark, sf_dir) -> DataFrame:
    """Of several files' values the last that isn't zero stays."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount").alias("file"), F.col("l_discount").alias("clock"))
    return combine.later_wins(li, ["t"], ["clock"])


@register("a07_orbit_file", f"WITH {STA} SELECT id * 900 AS t, 'G' || lpad(CAST(id % 32 + 1 AS VARCHAR), 2, '0') AS sat, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM sta")
def orbit_file(spark, sf_dir) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [(r.id * 900.0, f"G{r.id % 32 + 1:02d}", r.x, r.y, r.z, 1e-6) for r in pdf.itertuples()]
            yield pd.DataFrame([(int(t), s, round(x, 3), round(y, 3), round(z, 3)) for t, s, x, y, z, _ in grids.sp3(grids.write_sp3(rows))], columns=["t", "sat", "x", "y", "z"])

    return sta(spark, sf_dir).select("id", "x", "y", "z").mapInPandas(run, "t long, sat string, x double, y double, z double")


@register("b07_agent_service", f"""WITH RECURSIVE {STA}, {VSTA}, d AS (SELECT v.id AS vid, s.id, (v.x - s.x) * (v.x - s.x) + (v.y - s.y) * (v.y - s.y) + (v.z - s.z) * (v.z - s.z) AS d2 FROM vsta v JOIN customer c ON c.c_custkey = v.id AND c.c_acctbal > 0, sta s),
m AS (SELECT vid, id AS mountpoint FROM d QUALIFY row_number() OVER (PARTITION BY vid ORDER BY d2, id) = 1), s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events),
r AS (SELECT user_id, min(t) AS t FROM s GROUP BY 1 UNION ALL SELECT r.user_id, (SELECT min(s.t) FROM s WHERE s.user_id = r.user_id AND s.t - r.t >= 600) FROM r WHERE r.t IS NOT NULL)
SELECT m.vid, m.mountpoint, count(r.t) AS n_sent FROM m LEFT JOIN r ON r.user_id = m.vid GROUP BY 1, 2""")
def agent_service(spark, sf_dir) -> DataFrame:
    """Clients with an account get their nearest mountpoint, and its ephemerides once in 600 s at most."""
    ok = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("vid"))
    v = vsta(spark, sf_dir).select(F.col("id").alias("vid"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz")).join(ok, "vid", "left_semi")
    near = spatial.nearest(v, sta(spark, sf_dir).select("id", "x", "y", "z"), "vid", "id", ("vx", "vy", "vz"), ("x", "y", "z"), 1, 40_000.0, 2_000_000.0).select("vid", F.col("id").alias("mountpoint"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("vid"), (F.expr("unix_micros(cast(ts as timestamp))") / 1e6).alias("t")).distinct()
    sent = processors.throttled(e, "vid", "t", 600.0).groupBy("vid").agg(F.count("*").alias("n"))
    return near.join(sent, "vid", "left").select("vid", "mountpoint", F.coalesce("n", F.lit(0)).alias("n_sent"))


@register("b08_monitor_records", f"WITH {OBS}, m AS (SELECT srcid, max(epoch) AS epoch FROM obs GROUP BY srcid) SELECT o.srcid, string_agg('{{' || o.sat || ',' || o.snr || ',' || o.el || '}}', '' ORDER BY o.sat) AS record FROM obs o JOIN m ON m.srcid = o.srcid AND m.epoch = o.epoch GROUP BY o.srcid")
def monitor_records(spark, sf_dir) -> DataFrame:
    """A text record for each subscribed source: its latest epoch's satellites in braces (52 at most)."""
    from ..operators import network

    last = network.latest(obs(spark, sf_dir), ["srcid"], "epoch")
    one = F.struct(F.col("sat"), F.concat(F.lit("{"), F.concat_ws(",", *[F.col(c).cast("string") for c in ("sat", "snr", "el")]), F.lit("}")).alias("text"))
    return last.groupBy("srcid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda v: v["text"]), "").alias("record"))


def _lat(values: tuple[float, ...]) -> str:
    return f"({list(values)!r}[k] * (1 - a) + {list(values)!r}[k + 1] * a)"


_PT = [f"({_lat(m)} - {_lat(s)} * c)" for m, s in zip(augmentation.MEAN, augmentation.SEASON, strict=True)]


@register("g15_augmentation_troposphere", f"""WITH {STA}, q AS (SELECT id, lat, h, sin(radians(5 + id % 85)) AS s, cos(2 * pi() * (id % 365 + 1 - 28e0) / 365.25e0) AS c, CAST(least(greatest(floor(lat / 15e0), 1), 4) AS INT) AS k FROM sta), w AS (SELECT *, least(greatest(lat / 15e0 - k, 0), 1) AS a FROM q),
v AS (SELECT id, h, s, {_PT[0]} AS p, {_PT[1]} AS t, {_PT[2]} AS e, {_PT[3]} AS b, {_PT[4]} AS l FROM w)
SELECT id, round((1e-6 * 77.604e0 * 287.054e0 * p / 9.784e0 * pow(1 - b * h / t, 9.80665e0 / (287.054e0 * b)) + 1e-6 * 382000e0 * 287.054e0 / (9.784e0 * (l + 1) - b * 287.054e0) * e / t * pow(1 - b * h / t, (l + 1) * 9.80665e0 / (287.054e0 * b) - 1)) * 1.001e0 / sqrt(0.002001e0 + s * s), 7) AS trop FROM v""")
def augmentation_troposphere(spark, sf_dir) -> DataFrame:
    s = augmentation.with_troposphere(sta(spark, sf_dir), "trop", F.col("id") % 365 + 1, F.radians("lat"), F.col("h"), F.radians(5 + F.col("id") % 85))
    return s.select("id", F.round("trop", 7).alias("trop"))


@register("g15_augmentation_grid", """WITH q AS (SELECT event_id, (event_id % 97) / 97e0 AS x, (event_id % 89) / 89e0 AS y, CASE WHEN event_id % 5 = 1 THEN NULL ELSE value END AS c00, value + 1 AS c10, CASE WHEN event_id % 7 = 3 THEN NULL ELSE value + 2 END AS c01, CASE WHEN event_id % 3 = 2 THEN NULL ELSE value + 4 END AS c11 FROM events)
SELECT event_id, round(CASE WHEN c00 + c10 + c01 + c11 IS NOT NULL THEN (1 - x) * (1 - y) * c00 + x * (1 - y) * c10 + (1 - x) * y * c01 + x * y * c11 WHEN c00 IS NULL AND 2 - x - y <= 1 THEN (x + y - 1) * c11 + (1 - x) * c01 + (1 - y) * c10 WHEN c01 IS NULL AND 1 - x + y <= 1 THEN (x - y) * c10 + (1 - x) * c00 + y * c11 WHEN c11 IS NULL AND x + y <= 1 THEN (1 - x - y) * c00 + x * c10 + y * c01 END * 0.190293672798365, 6) AS delay FROM q""")
def augmentation_grid(spark, sf_dir) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    e = table(spark, sf_dir, "events").select("event_id", ((k % 97) / 97e0).alias("x"), ((k % 89) / 89e0).alias("y"), F.when(k % 5 != 1, v).alias("c00"), (v + 1).alias("c10"), F.when(k % 7 != 3, v + 2).alias("c01"), F.when(k % 3 != 2, v + 4).alias("c11"))
    d = augmentation.grid_delay(F.col("x"), F.col("y"), {(i, j): F.col(f"c{i}{j}") for i in (0, 1) for j in (0, 1)})
    return e.select("event_id", F.round(d * 0.190293672798365, 6).alias("delay"))


@register("g11_sun_and_moon")
def sun_and_moon(spark, sf_dir) -> DataFrame:
    from ..kernels import orbits

    def run(batches):
        for pdf in batches:
            sun, moon = orbits.sun_moon(pdf["t"].to_numpy(float))
            yield pd.DataFrame({"o_orderkey": pdf["o_orderkey"], "sun": np.linalg.norm(sun, axis=1).round(0), "moon": np.linalg.norm(moon, axis=1).round(0)})

    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000") - 946728000).alias("t"))
    return o.mapInPandas(run, "o_orderkey long, sun double, moon double")


@register("a18_source_shards", "SELECT s_nationkey % 4 AS caster, s_suppkey AS source, (row_number() OVER (PARTITION BY s_nationkey % 4 ORDER BY s_suppkey) - 1) // 1024 AS worker FROM supplier")
def source_shards(spark, sf_dir) -> DataFrame:
    """Sources of a caster to workers of 1024."""
    from pyspark.sql import Window

    w = Window.partitionBy("caster").orderBy("source")
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 4).alias("caster"), F.col("s_suppkey").alias("source"))
    return s.withColumn("worker", F.floor((F.row_number().over(w) - 1) / 1024).cast("long"))


@register("h03_message_rows", f"WITH {STA} SELECT id, 1005 AS type, 5 AS class, round(round(x / 1e-4) * 1e-4, 4) AS x FROM sta")
def message_rows(spark, sf_dir) -> DataFrame:
    """Messages decoded by a table function beside the rows they came from."""
    from ..functions import tables as functions
    from ..kernels import rtcm

    def encode(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "body": [rtcm.encode_fields(1005, {"x": x}) for x in pdf["x"]]})

    functions.register(spark)
    m = sta(spark, sf_dir).select("id", "x").mapInPandas(encode, "id long, body binary")
    rows = m.lateralJoin(functions.DecodedMessage(F.col("body").outer()))
    return rows.select("id", "type", "class", F.round(F.get_json_object("fields", "$.x").cast("double"), 4).alias("x"))
