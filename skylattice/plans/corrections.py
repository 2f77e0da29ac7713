"""Corrected satellites, precise points, and corrections matched in a stream.

The true orbits are the circular ones of baselines.py; the broadcast ephemerides are off by metres along and across the orbit and in their
clocks, and the corrections are what is missing, in the axes of the broadcast orbit at their time. A second ephemeris of another issue, nearer in
time, is false by kilometres: who takes it isn't near the truth."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import orbit
from ..operators import corrections
from ..operators.staging import staged
from ..streaming import corrections as stream
from ..streaming import processors
from .baselines import EPOCHS, GRAVITY, LIGHT, RADIUS, SPIN, TILT, band_observations, circular
from .registry import register
from .streams import _scratch
from .surrogate import STA, sta, table

#: Satellites whose corrections end after an epoch, and those without clock corrections: k % 6 = 3, k % 11 = 4.
LAST = 5
TOE, DECOY = 3600.0, 7200.0


def _broadcast(k: Column, t: Column, false: float = 0.0) -> tuple[Column, Column, Column]:
    """Place of the broadcast orbit at time t, in the earth's frame of t."""
    plane = F.floor(k / 5)
    u = 2 * math.pi * (k % 5 / 5.0 + plane / 15.0) + math.sqrt(GRAVITY / RADIUS**3) * t + 1e-7 * (k % 5 - 2) + false
    node = math.pi / 3 * plane + 5e-8 * (k % 3) - SPIN * t
    along, across = F.cos(u), F.sin(u) * math.cos(TILT)
    return RADIUS * (along * F.cos(node) - across * F.sin(node)), RADIUS * (along * F.sin(node) + across * F.cos(node)), RADIUS * math.sin(TILT) * F.sin(u)


def _missing(k: Column, t: Column) -> Column:
    """Radial, along and across parts of broadcast less true place, as an array."""

    def split(s: Column) -> Column:
        at, speed, off = (tuple(s[n][c] for c in "xyz") for n in ("at", "speed", "off"))
        along, across = corrections._unit(speed), corrections._unit(corrections._cross(at, speed))
        return F.array(*[sum(a * o for a, o in zip(axis, off, strict=True)) for axis in (corrections._cross(along, across), along, across)])

    triple = lambda v: F.struct(*[c.alias(n) for c, n in zip(v, "xyz", strict=True)])
    at, last, later, true = _broadcast(k, t), _broadcast(k, t - 1.0), _broadcast(k, t + 1.0), circular(k, t, t)
    speed, off = tuple((b - a) / 2 for a, b in zip(last, later, strict=True)), tuple(a - b for a, b in zip(at, true, strict=True))
    return orbit.let(F.struct(triple(at).alias("at"), triple(speed).alias("speed"), triple(off).alias("off")), split)


def correction_events(spark: SparkSession) -> DataFrame:
    """EVENTS: an orbit correction twenty seconds before each epoch, clocks with it and ten seconds later."""
    k, t0 = F.col("k"), F.col("t0")
    plane = F.floor(k / 5)
    given = {"a": F.lit(RADIUS), "i0": F.lit(TILT), "omg0": math.pi / 3 * plane + 5e-8 * (k % 3), "f0": 1e-5 * (k - 15) + 5e-9 * (k % 4), "f1": 1e-13 * (k % 2)}
    given["m0"] = 2 * math.pi * (k % 5 / 5.0 + plane / 15.0) + math.sqrt(GRAVITY / RADIUS**3) * F.col("toe") + 1e-7 * (k % 5 - 2) + F.when(F.col("toe") == DECOY, 1e-3).otherwise(0.0)
    e = spark.range(30).withColumnRenamed("id", "k").withColumn("toe", F.explode(F.array(F.lit(TOE), F.lit(DECOY))))
    numbers = F.array(*[given.get(c, F.lit(0.0)).cast("double") if c != "toe" else F.col("toe") for c in orbit.ELEMENTS])
    none = F.lit(None)
    e = e.select((k + 1).alias("sat"), F.timestamp_seconds(F.lit(0)).alias("at"), F.lit("ephemeris").alias("kind"), F.col("toe").alias("t0"), none.cast("long").alias("iod"), F.when(F.col("toe") == TOE, 40).otherwise(41).cast("long").alias("iode"), numbers.alias("numbers"), none.cast("double").alias("udi"))
    c = spark.range(30).withColumnRenamed("id", "k").withColumn("epoch", F.explode(F.array(*map(F.lit, EPOCHS)))).filter((k % 6 != 3) | (F.col("epoch") <= EPOCHS[LAST]))
    iod = F.floor(F.col("epoch") / 600) % 16
    mid = t0 + 5.0
    rates = F.zip_with(_missing(k, mid + 30.0), _missing(k, mid - 30.0), lambda a, b: (a - b) / 60.0)
    o = c.withColumn("t0", F.col("epoch") - 20.0).select((k + 1).alias("sat"), F.timestamp_seconds(t0).alias("at"), F.lit("orbit"), "t0", iod, F.lit(40).cast("long"), F.concat(_missing(k, mid), rates), F.lit(10.0))
    n = c.filter(k % 11 != 4).withColumn("t0", F.explode(F.array(F.col("epoch") - 20.0, F.col("epoch") - 10.0)))
    drift = F.array(-LIGHT * (5e-9 * (k % 4) + 1e-13 * (k % 2) * (t0 - TOE)), -LIGHT * 1e-13 * (k % 2), F.lit(0.0))
    n = n.select((k + 1).alias("sat"), F.timestamp_seconds(t0).alias("at"), F.lit("clock"), "t0", iod, none.cast("long"), drift, F.lit(0.0))
    return e.unionAll(o).unionAll(n)


def _corrected(spark: SparkSession, sf_dir: str, mask: float, zenith: float) -> DataFrame:
    places = sta(spark, sf_dir).select(F.col("id").alias("srcid"), "x", "y", "z")
    obs = staged(band_observations(places, mask, zenith).join(places.select("srcid", *[F.col(c).alias(f"{c}0") for c in "xyz"]), "srcid"))
    return corrections.with_corrected_satellites(obs, staged(corrections.matched(correction_events(spark))))


@register("g19_corrected_satellites", f"""WITH {STA}, e AS (SELECT unnest([{', '.join(str(int(t)) for t in EPOCHS)}]) AS t), s AS (SELECT unnest(range(30)) AS k)
SELECT id AS srcid, t, k + 1 AS sat, true AS is_near FROM sta, e, s WHERE k % 11 <> 4 AND (k % 6 <> 3 OR t <= {int(EPOCHS[LAST])})""")
def corrected_satellites(spark, sf_dir) -> DataFrame:
    """Satellites as seen from all stations, below the horizon too: within 5 cm of the true orbit and clock wherever a correction holds."""
    x = _corrected(spark, sf_dir, -math.pi / 2, 0.0)
    k = F.col("sat") - 1
    sent = F.col("t") - F.col("p") / LIGHT - 1e-5 * (k - 15)  # the satellite's clock less its offset
    off = sum((F.col(f"s{c}") - v) * (F.col(f"s{c}") - v) for c, v in zip("xyz", circular(k, sent, sent), strict=True))
    near = (F.sqrt(off) < 0.05) & (F.abs(F.col("sclock") - LIGHT * 1e-5 * (k - 15)) < 0.05)
    return x.select("srcid", F.col("t").cast("long").alias("t"), "sat", near.alias("is_near"))


@register("i07_precise_points", f"WITH {STA} SELECT id AS srcid, {len(EPOCHS)} AS epochs, true AS is_near FROM sta")
def precise_points(spark, sf_dir) -> DataFrame:
    """Stations by corrected satellites and two bands without the ionosphere: after two hours within a decimetre."""
    x = _corrected(spark, sf_dir, 0.2, 2.31)
    f1, f2 = 1575.42, 1227.60
    a, b = f1 * f1 / (f1 * f1 - f2 * f2), f2 * f2 / (f1 * f1 - f2 * f2)
    w1, w2 = LIGHT / 1575.42e6, LIGHT / 1227.60e6
    one, two = F.col("bands")[0], F.col("bands")[1]
    x = x.filter(one["snr"] > 30).withColumns({"code": a * one["p"] - b * two["p"], "phase": a * w1 * one["l"] - b * w2 * two["l"], "slip": one["slip"] | two["slip"], **{f"{c}0": F.col(f"{c}0") + 3.0 for c in "xyz"}})
    got = corrections.precise_points(x)
    last = got.groupBy("srcid").agg(F.count("*").cast("int").alias("epochs"), F.max_by(F.struct("x", "y", "z"), "t").alias("_p"))
    s = sta(spark, sf_dir).select(F.col("id").alias("srcid"), "x", "y", "z")
    far = F.sqrt(sum((F.col(f"_p.{c}") - F.col(c)) * (F.col(f"_p.{c}") - F.col(c)) for c in "xyz"))
    return last.join(s, "srcid").select("srcid", "epochs", (far < 0.1).alias("is_near"))


@contextmanager
def column_families(spark: SparkSession) -> Iterator[None]:
    """The state store with column families, which keyed maps and timers need, for what runs inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)


#: Events as corrections: clicks are clocks, views orbits, the rest ephemerides; issues by hours and by half days, times by seconds.
ISSUES = """ev AS (SELECT user_id AS sat, CASE event_type WHEN 'click' THEN 'clock' WHEN 'view' THEN 'orbit' ELSE 'ephemeris' END AS kind, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS t0, epoch_us(ts) // 1000000 // 86400 % 64 AS iod, epoch_us(ts) // 1000000 // 172800 % 32 AS iode FROM events)"""
SCALE = 3000.0


@register("g19_matched_stream", f"""WITH {ISSUES}, c AS (SELECT DISTINCT sat, t0 / {SCALE} AS t0, iod FROM ev WHERE kind = 'clock'), o AS (SELECT DISTINCT sat, t0 / {SCALE} AS t0, iod, iode FROM ev WHERE kind = 'orbit'), e AS (SELECT DISTINCT sat, t0 / {SCALE} AS t0, iode FROM ev WHERE kind = 'ephemeris'),
co AS (SELECT c.sat, c.t0, c.iod, o.iode, o.t0 AS orbit_t0 FROM c JOIN o ON o.sat = c.sat AND o.iod = c.iod AND o.t0 <= c.t0 AND c.t0 - o.t0 <= 90 QUALIFY row_number() OVER (PARTITION BY c.sat, c.t0, c.iod ORDER BY o.t0 DESC, o.iode DESC) = 1),
m AS (SELECT co.*, e.t0 AS toe FROM co JOIN e ON e.sat = co.sat AND e.iode = co.iode AND abs(e.t0 - co.t0) <= 7200 QUALIFY row_number() OVER (PARTITION BY co.sat, co.t0, co.iod ORDER BY abs(e.t0 - co.t0), e.t0 DESC) = 1)
SELECT sat, round(t0, 3) AS t0, iod, iode, round(orbit_t0, 3) AS orbit_t0, round(toe, 3) AS toe FROM m WHERE floor(t0 * 1000) + 200000 <= (SELECT max(floor(t0 / {SCALE} * 1000)) FROM ev) - 60000""")
def matched_stream(spark, sf_dir) -> DataFrame:
    """The stream form to its end, over events with their times divided by SCALE (so that some lie within AGE). Clock rows that the last watermark
    hasn't reached are still waiting."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    kind = F.when(F.col("event_type") == "click", "clock").when(F.col("event_type") == "view", "orbit").otherwise("ephemeris")
    t0 = s.cast("double") / SCALE
    numbers = F.array(*[t0 if c == "toe" else F.lit(0.0) for c in orbit.ELEMENTS])
    e = e.select(F.col("user_id").alias("sat"), F.timestamp_millis(F.floor(t0 * 1000)).alias("at"), kind.alias("kind"), t0.alias("t0"), (F.floor(s / 86400) % 64).alias("iod"), (F.floor(s / 172800) % 32).alias("iode"), numbers.alias("numbers"), F.lit(0.0).alias("udi"))
    with column_families(spark):
        got = processors.run_to_table(stream.matched(e, "60 seconds", 200.0), _scratch(spark))
    return got.select("sat", F.round("t0", 3).alias("t0"), "iod", "iode", F.round("orbit_t0", 3).alias("orbit_t0"), F.round(F.col("elements")[0], 3).alias("toe"))
