"""Positions from tables of observations and ephemerides, and the slip detectors of two frequencies.

The tables are made once from the stations' places by column expressions; what reads them knows only the tables, and the oracle is where
the stations are."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import atmosphere, geodesy, orbit
from ..operators import observations as ob
from ..operators import pointing
from ..operators.staging import staged
from .registry import register
from .surrogate import SERIES, STA, series, sta

#: Seconds of the week at which the stations observe, and the ephemerides' reference times.
EPOCHS, TOES = (900, 4500, 11700), (0, 7200, 14400)
#: Each round leaves less than a hundred-thousandth of a range's error, thousands of kilometres at first: after three a nanometre.
ROUNDS = 3
#: Wavelengths of two frequencies, m.
WAVE1, WAVE2 = 0.190293672798365, 0.244210213424568


def ephemerides(spark: SparkSession, stale: bool = True) -> DataFrame:
    """30 satellites in six planes, one ephemeris for each reference time, and a stale one of an earlier issue with a false place."""
    k = F.col("k")
    s = spark.range(30).withColumnRenamed("id", "k").withColumn("toe", F.explode(F.array(*map(F.lit, TOES))))
    s = s.withColumn("old", F.explode(F.array(F.lit(False), F.lit(True)) if stale else F.array(F.lit(False))))
    a, plane = 26560e3, F.floor(k / 5)
    speed = math.sqrt(orbit.MU / a**3)
    m0 = 2 * math.pi * (k % 5 / 5.0 + plane / 15.0) + speed * F.col("toe") + F.when(F.col("old"), 0.001).otherwise(0.0)
    given = {
        "a": F.lit(a), "e": 0.001 * (k % 10), "i0": F.lit(math.radians(55)), "omg0": math.pi / 3 * plane, "m0": m0, "f0": 1e-5 * (k - 15) + 1e-11 * k * F.col("toe"), "f1": 1e-11 * k,
        "cus": F.lit(1e-6), "cuc": F.lit(-2e-6), "crs": F.lit(20.0), "crc": F.lit(150.0), "cis": F.lit(5e-8), "cic": F.lit(-3e-8),
    }
    rest = [given.get(c, F.lit(0.0)).cast("double").alias(c) for c in orbit.ELEMENTS if c != "toe"]
    return s.select((k + 1).alias("sat"), F.when(F.col("old"), 10).otherwise(11).alias("iode"), F.col("toe").cast("double").alias("toe"), *rest)


def observations(spark: SparkSession, sf_dir: str, mask: float = 0.15) -> DataFrame:
    """srcid, t (of the receiver's clock), sat, p of all stations: the range to where the satellite was, clocks and both atmospheres."""
    own = ephemerides(spark, stale=False).filter("toe = 7200").select("sat", F.struct(*orbit.ELEMENTS).alias("_e"))
    s = sta(spark, sf_dir).withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in EPOCHS]))).withColumn("_sat", F.explode(F.sequence(F.lit(1), F.lit(30))))
    s = s.withColumn("_lat", F.radians("lat")).withColumn("_lon", F.radians("lon")).withColumn("_dt", 100.0 + F.col("id") % 50)
    s = s.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "_sat")  # few rows with long work
    s = s.join(F.broadcast(own), F.col("_sat") == own["sat"])  # 30 rows
    e, here = F.col("_e"), tuple(F.col(c) for c in "xyz")

    t, p, place = F.col("t"), F.col("p"), (F.col("_lat"), F.col("_lon"))
    s, kept = s.withColumn("p", F.lit(2.2e7)), [c for c in s.columns if c != "p"]
    for _ in range(ROUNDS):  # step by step, so that each is compiled code
        s = s.withColumn("_at", t - p / geodesy.C).withColumn("_sent", F.col("_at") - orbit.clock(e, F.col("_at")))
        s = orbit.with_satellite(s, "_e", {"_s": "_sent"}, steps=4)  # the orbits are nearly round
        there = tuple(F.col(f"_s{c}") for c in "xyz")
        az, el = geodesy.direction(geodesy.to_enu(*place, tuple(a - b for a, b in zip(there, here, strict=True))))
        far = geodesy.geometric_range(there, here) + F.col("_dt") - geodesy.C * F.col("_sclock")
        s = s.select(*kept, orbit.once(F.struct(far.alias("far"), az.alias("az"), el.alias("el"))).alias("_m"))
        delay = atmosphere.klobuchar(t, *place, F.col("_m.az"), F.col("_m.el")) + atmosphere.saastamoinen(F.col("_lat"), F.col("h"), F.col("_m.el"))
        s = s.select(*kept, F.col("_m.el").alias("_el"), orbit.once(F.col("_m.far") + delay).alias("p"))
    return s.filter(F.col("_el") > mask).select(F.col("id").alias("srcid"), "t", F.col("sat").cast("long").alias("sat"), "p")


@register("i01_positioning_chain", f"WITH {STA} SELECT id, CAST(t AS BIGINT) AS t, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, CAST(100 + id % 50 AS DOUBLE) AS dt FROM sta, (SELECT unnest([900, 4500, 11700]) AS t)")
def positioning_chain(spark, sf_dir) -> DataFrame:
    """Observations joined with the ephemeris in force, satellites, delays, positions by epoch."""
    got = pointing.single_points(staged(observations(spark, sf_dir)), ephemerides(spark))
    return got.select(F.col("srcid").alias("id"), F.col("t").cast("long").alias("t"), *[F.round(c, 2).alias(c) for c in "xyz"], F.round("dt", 3).alias("dt"))


KEYS, ORDER = ["user_id", "event_type"], ["t", "event_id"]
#: Phases (cycles) and ranges (m) on two frequencies, with jumps in some, and a receiver's flags.
DUAL = f"{SERIES}, dual AS (SELECT *, value * 10 AS l1, value * 7.79e0 + CASE WHEN event_id % 5 = 0 THEN 3e0 ELSE 0e0 END AS l2, value * 1.9e0 AS p1, value * 1.9e0 + event_id % 3 AS p2, (event_id * 7) % 11 % 4 AS lli FROM series)"


def _dual(spark, sf_dir) -> DataFrame:
    v, k = F.col("value"), F.col("event_id")
    return series(spark, sf_dir).withColumns({"l1": v * 10, "l2": v * 7.79e0 + F.when(k % 5 == 0, 3e0).otherwise(0e0), "p1": v * 1.9e0, "p2": v * 1.9e0 + k % 3, "lli": k * 7 % 11 % 4})


@register("d09_lost_lock", f"WITH {DUAL} SELECT user_id, event_type, event_id, lli & 1 <> 0 OR coalesce(xor(lli, lag(lli) OVER w) & 2 <> 0, false) AS slip FROM dual WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, event_id)")
def lost_lock(spark, sf_dir) -> DataFrame:
    return ob.lost_lock(_dual(spark, sf_dir), KEYS, ORDER, "lli").select(*KEYS, "event_id", "slip")


def _jumps(value: str) -> str:
    return f"""c AS (SELECT user_id, event_type, event_id, t, {value} AS v FROM dual), j AS (SELECT *, coalesce(abs(v - lag(v) OVER w) > {{limit}}, false) AS slip, coalesce(t - lag(t) OVER w > 864000, false) AS gap FROM c WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, event_id))
SELECT user_id, event_type, event_id, slip, gap, CAST(sum(CASE WHEN slip OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS arc FROM j"""


@register("d09_geometry_free", f"WITH {DUAL}, " + _jumps(f"l1 * {WAVE1} - l2 * {WAVE2}").format(limit=0.6))
def geometry_free(spark, sf_dir) -> DataFrame:
    x = _dual(spark, sf_dir).withColumn("v", ob.geometry_free(F.col("l1"), F.col("l2"), WAVE1, WAVE2))
    return ob.slips(x, KEYS, ORDER, "v", 0.6, 864000.0, "t").select(*KEYS, "event_id", "slip", "gap", "arc")


@register("d09_wide_lane", f"WITH {DUAL}, " + _jumps(f"l1 - l2 - {(WAVE2 - WAVE1) / (WAVE2 + WAVE1)!r} * (p1 / {WAVE1} + p2 / {WAVE2})").format(limit=60.0))
def wide_lane(spark, sf_dir) -> DataFrame:
    x = _dual(spark, sf_dir).withColumn("v", ob.wide_lane(*[F.col(c) for c in ("l1", "l2", "p1", "p2")], WAVE1, WAVE2))
    return ob.slips(x, KEYS, ORDER, "v", 60.0, 864000.0, "t").select(*KEYS, "event_id", "slip", "gap", "arc")
