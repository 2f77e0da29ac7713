"""Sun and moon, tides and attitudes with SQL twins that sum the same published series by themselves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import celestial, loading
from ..operators import timejoin
from ..sources import tables
from .baselines import GRAVITY, RADIUS, SPIN, TILT, circular
from .registry import register
from .surrogate import STA, sta, table

R = "* 0.017453292519943295"
#: From rows with ut: d, the angles reduced to a turn, ecliptic places, earth-fixed places.
SKY = f"""a0 AS (SELECT *, ut / 86400e0 AS d FROM rows),
a1 AS (SELECT *, 357.5277233e0 + 0.98560028e0 * d AS g, 280.460e0 + 0.9856474e0 * d AS q, 218.316e0 + 13.176396e0 * d AS lm, 134.963e0 + 13.064993e0 * d AS mm, 93.272e0 + 13.229350e0 * d AS fm, 297.850e0 + 12.190749e0 * d AS em, 23.439291e0 - 3.56e-7 * d AS tl, 280.46061837e0 + 360.98564736629e0 * d AS th FROM a0),
a2 AS (SELECT * REPLACE ({", ".join(f"({c} - 360e0 * floor({c} / 360e0)) {R} AS {c}" for c in ("g", "q", "lm", "mm", "fm", "em", "tl", "th"))}) FROM a1),
a3 AS (SELECT *, q + (1.915e0 * sin(g) + 0.020e0 * sin(2 * g)) {R} AS ls, 1.495978707e11 * (1.000140612e0 - 0.016708617e0 * cos(g) - 0.000139589e0 * cos(2 * g)) AS rs,
  lm + (6.289e0 * sin(mm) + 1.274e0 * sin(2 * em - mm) + 0.658e0 * sin(2 * em)) {R} AS lo, 5.128e0 * sin(fm) {R} AS bm, 385001000e0 - 20905000e0 * cos(mm) - 3699000e0 * cos(2 * em - mm) - 2956000e0 * cos(2 * em) AS rm FROM a2),
a4 AS (SELECT *, rs * cos(ls) AS s0, rs * cos(tl) * sin(ls) AS s1, rs * sin(tl) * sin(ls) AS sun_z, rm * cos(bm) * cos(lo) AS m0, rm * (cos(tl) * cos(bm) * sin(lo) - sin(tl) * sin(bm)) AS m1, rm * (sin(tl) * cos(bm) * sin(lo) + cos(tl) * sin(bm)) AS moon_z FROM a3),
sky AS (SELECT *, cos(th) * s0 + sin(th) * s1 AS sun_x, cos(th) * s1 - sin(th) * s0 AS sun_y, cos(th) * m0 + sin(th) * m1 AS moon_x, cos(th) * m1 - sin(th) * m0 AS moon_y FROM a4)"""
BODIES = [f"{n}_{a}" for n in ("sun", "moon") for a in "xyz"]


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000") - 946728000 + F.col("o_orderkey") % 86400).cast("double").alias("ut"))


ORDERS = "rows AS (SELECT o_orderkey, o_custkey, CAST(epoch_us(o_orderdate) // 1000000 - 946728000 + o_orderkey % 86400 AS DOUBLE) AS ut FROM orders)"


@register("g11_sun_and_moon_places", f"WITH {ORDERS}, {SKY} SELECT o_orderkey, {', '.join(f'round({c} / 1000e0) + 0e0 AS {c}' for c in BODIES)} FROM sky")
def sun_and_moon_places(spark, sf_dir) -> DataFrame:
    """Earth-fixed places in whole kilometres at the seconds of all orders."""
    x = celestial.with_sun_and_moon(_orders(spark, sf_dir), "ut")
    return x.select("o_orderkey", *[(F.round(F.col(c) / 1000e0) + 0e0).alias(c) for c in BODIES])


def _pull(n: str, mu: str, a: str) -> str:
    d = f"sqrt({n}_x * {n}_x + {n}_y * {n}_y + {n}_z * {n}_z)"
    c = f"((x * {n}_x + y * {n}_y + z * {n}_z) / (r * {d}))"
    return f"{mu} / 3.986004415e14 * r * r * r * r / ({d} * {d} * {d}) * (0.6078e0 * {a} / r * (1.5e0 * {c} * {c} - 0.5e0) + 0.2541e0 * {c} * ({n}_{a} / {d} - {c} * {a} / r))"


@register("g21_tide_displacement", f"""WITH {STA}, rows AS (SELECT id, h, CAST(id * 3600 + h * 7200 AS DOUBLE) AS ut, x, y, z, sqrt(x * x + y * y + z * z) AS r FROM (SELECT * EXCLUDE (h) FROM sta), (SELECT unnest(range(12)) AS h)), {SKY}
SELECT id, h, {', '.join(f"round({_pull('sun', '1.32712440018e20', a)} + {_pull('moon', '4.902801e12', a)}, 6) + 0e0 AS d{a}" for a in "xyz")} FROM sky""")
def tide_displacement(spark, sf_dir) -> DataFrame:
    """Stations moved by the solid tide, to the micrometre, through a day."""
    s = sta(spark, sf_dir).select("id", "x", "y", "z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("h"))
    s = s.withColumn("ut", (F.col("id") * 3600 + F.col("h") * 7200).cast("double"))
    t = celestial.with_solid_tide(celestial.with_sun_and_moon(s, "ut"), "x", "y", "z")
    return t.select("id", "h", *[(F.round(f"tide_{a}", 6) + 0e0).alias(f"d{a}") for a in "xyz"])


def _hours(s: DataFrame) -> DataFrame:
    return s.withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")))).withColumn("ut", (F.col("id") * 86400 + F.col("h") * 7200).cast("double"))


@register("g21_ocean_loading", f"""WITH {STA}, rows AS (SELECT id, h, CAST(id * 86400 + h * 7200 AS DOUBLE) + 43200 AS since FROM (SELECT id FROM sta0), (SELECT unnest(range(12)) AS h)),
w(i, speed, a, b, c, turn) AS (VALUES (0, 1.40519e-4, 2, -2, 0, 0e0), (1, 1.45444e-4, 0, 0, 0, 0e0), (2, 1.37880e-4, 2, -3, 1, 0e0), (3, 1.45842e-4, 2, 0, 0, 0e0), (4, 0.72921e-4, 1, 0, 0, 0.25e0), (5, 0.67598e-4, 1, -2, 0, -0.25e0), (6, 0.72523e-4, -1, 0, 0, -0.25e0), (7, 0.64959e-4, 1, -3, 1, -0.25e0), (8, 0.53234e-5, 0, 2, 0, 0e0), (9, 0.26392e-5, 0, 1, -1, 0e0), (10, 0.03982e-5, 2, 0, 0, 0e0)),
d AS (SELECT *, floor(since / 86400e0) AS day FROM rows), c AS (SELECT *, since - day * 86400e0 AS s, (27392.500528e0 + 1.000000035e0 * (day + 9132)) / 36525e0 AS t FROM d),
m AS (SELECT *, radians(279.69668e0 + 36000.768930485e0 * t + 3.03e-4 * t * t) AS h0, radians(270.434358e0 + 481267.88314137e0 * t - 0.001133e0 * t * t + 1.9e-6 * t * t * t) AS s0, radians(334.329653e0 + 4069.0340329577e0 * t - 0.010325e0 * t * t - 1.2e-5 * t * t * t) AS p0 FROM c),
g AS (SELECT id, h, i, speed * s + a * h0 + b * s0 + w.c * p0 + 2 * pi() * turn AS ang FROM m, w)
SELECT id, h, {", ".join(f"round({s}sum((id % {k} + i + 1) / {v}e0 * cos(ang - radians((id * 13 + i * 29 + {r}) % 360 - 180))), 6) + 0e0 AS {n}" for n, s, k, v, r in (("east", "-", 5, 2000, 31), ("north", "-", 3, 4000, 62), ("up", "", 7, 1000, 0)))} FROM g GROUP BY id, h""")
def ocean_loading(spark, sf_dir) -> DataFrame:
    """Stations moved by the ocean's load, to the micrometre, from the text of a loading file (a block each) that is written and read here."""
    s = sta(spark, sf_dir).select("id")
    numbers = lambda form, f: F.concat(*[F.format_string(form, f(i)) for i in range(11)])
    high = [numbers(" %10.7f", lambda i, k=k, v=v: (F.col("id") % k + i + 1) / float(v)) for k, v in ((7, 1000), (5, 2000), (3, 4000))]
    late = [numbers(" %6.1f", lambda i, r=r: ((F.col("id") * 13 + i * 29 + r) % 360 - 180).cast("double")) for r in (0, 31, 62)]
    text = [F.lit("$$ loading of one station"), F.concat(F.lit("  s"), F.col("id").cast("string")), *high[:1], F.lit("$$ west, south"), *high[1:], *late]
    lines = s.select((F.col("id") % 16).alias("file"), F.col("id"), F.posexplode(F.array(*text)).alias("k", "line")).select("file", "line", (F.col("id") * 16 + F.col("k")).alias("at"))
    waves = tables.ocean_loading(lines, "line", "at", "file")
    got = loading.with_ocean_loading(_hours(s.join(waves, F.concat(F.lit("S"), F.col("id").cast("string")) == F.col("station"))), "ut", "waves")
    return got.select("id", "h", *[(F.round(f"ocean_{c[0]}", 6) + 0e0).alias(c) for c in ("east", "north", "up")])


@register("g21_pole_tide", f"""WITH {STA}, rows AS (SELECT id, h, radians(lat) AS la, radians(lon) AS lo, (CAST(id * 86400 + h * 7200 AS DOUBLE) + 43200) / 86400e0 AS d FROM (SELECT id, lat, lon FROM sta0), (SELECT unnest(range(12)) AS h)),
e AS (SELECT s_suppkey AS day, (s_suppkey * 7919 % 400000) / 1e6 AS x, (s_suppkey * 104729 % 500000) / 1e6 AS y FROM supplier),
v AS (SELECT r.*, a.x + (d - a.day) * (b.x - a.x) AS xp, a.y + (d - a.day) * (b.y - a.y) AS yp, d / 365.25e0 AS n FROM rows r JOIN e a ON a.day = floor(d) JOIN e b ON b.day = a.day + 1),
m AS (SELECT *, xp - CASE WHEN d < 3653 THEN 55.974e0 + 1.8243e0 * n + 0.18413e0 * n * n + 0.007024e0 * n * n * n ELSE 23.513e0 + 7.6141e0 * n END / 1000 AS m1, CASE WHEN d < 3653 THEN 346.346e0 + 1.7896e0 * n - 0.10729e0 * n * n - 0.000908e0 * n * n * n ELSE 358.891e0 - 0.6287e0 * n END / 1000 - yp AS m2 FROM v)
SELECT id, h, round(0.009e0 * sin(la) * (m1 * sin(lo) - m2 * cos(lo)), 6) + 0e0 AS east, round(-0.009e0 * cos(2 * la) * (m1 * cos(lo) + m2 * sin(lo)), 6) + 0e0 AS north, round(-0.033e0 * sin(2 * la) * (m1 * cos(lo) + m2 * sin(lo)), 6) + 0e0 AS up FROM m""")
def pole_tide(spark, sf_dir) -> DataFrame:
    """Stations moved by the pole's motion, its place between the days of an earth orientation table that is written and read here."""
    k = F.col("s_suppkey")
    line = F.format_string("%d.00 %d %d 0 0", k + 51544, k * 7919 % 400000, k * 104729 % 500000)
    days = tables.earth_orientation(table(spark, sf_dir, "supplier").select(line.alias("line")), "line").withColumn("all", F.lit(0))
    s = _hours(sta(spark, sf_dir).select("id", F.radians("lat").alias("lat"), F.radians("lon").alias("lon"), F.lit(0).alias("all")))
    s = s.withColumn("mjd_at", (F.col("ut") + 43200.0) / 86400.0 + 51544.0)
    got = loading.with_pole_tide(timejoin.interpolated(s, days, ["all"], "mjd_at", "mjd", ["xp", "yp"], 1.0), "ut", "lat", "lon", "xp", "yp")
    return got.select("id", "h", *[(F.round(f"pole_{c[0]}", 6) + 0e0).alias(c) for c in ("east", "north", "up")])


def _d(v: float) -> str:
    """v as a double: SQL takes digits without an exponent for a decimal."""
    return repr(v) if "e" in repr(v) else f"{v!r}e0"


_U = f"({_d(2 * math.pi)} * (k % 5 / 5e0 + floor(k / 5e0) / 15e0) + {_d(math.sqrt(GRAVITY / RADIUS**3))} * w)"
_O = f"({_d(math.pi / 3)} * floor(k / 5e0) - {_d(SPIN)} * w)"
_C, _S = _d(math.cos(TILT)), _d(math.sin(TILT))


def _place(u: str, o: str) -> list[str]:
    return [f"{_d(RADIUS)} * (cos({u}) * cos({o}) - sin({u}) * {_C} * sin({o}))", f"{_d(RADIUS)} * (cos({u}) * sin({o}) + sin({u}) * {_C} * cos({o}))", f"{_d(RADIUS)} * {_S} * sin({u})"]


@register("g24_attitude_and_eclipse", f"""WITH {ORDERS.replace("ut FROM orders", "ut, CAST(epoch_us(o_orderdate) // 1000000 % 604800 + o_orderkey % 86400 AS DOUBLE) AS w, o_custkey % 30 AS k FROM orders")}, {SKY},
o AS (SELECT o_orderkey, sun_x, sun_y, sun_z, {", ".join(f"{p} AS {a}" for a, p in zip("xyz", _place(_U, _O), strict=True))}, {", ".join(f"{p} AS w{a}" for a, p in zip("xyz", _place(f"({_U} + {_d(math.pi / 2)})", _O), strict=True))}, sqrt(sun_x * sun_x + sun_y * sun_y + sun_z * sun_z) AS sd FROM sky),
n AS (SELECT *, (y * wz - z * wy) / 7.054336e14 AS nx, (z * wx - x * wz) / 7.054336e14 AS ny, (x * wy - y * wx) / 7.054336e14 AS nz, (x * sun_x + y * sun_y + z * sun_z) / ({_d(RADIUS)} * sd) AS up FROM o),
p AS (SELECT *, sun_y * nz - sun_z * ny AS px, sun_z * nx - sun_x * nz AS py, sun_x * ny - sun_y * nx AS pz, asin((sun_x * nx + sun_y * ny + sun_z * nz) / sd) AS beta FROM n)
SELECT o_orderkey, round(degrees(beta), 5) + 0e0 AS beta, round(degrees(atan2(-tan(beta), (x * px + y * py + z * pz) / ({_d(RADIUS)} * sqrt(px * px + py * py + pz * pz))) + pi()), 4) + 0e0 AS yaw, up < 0 AND {_d(RADIUS)} * sqrt(1 - up * up) <= 6378137e0 AS eclipsed FROM p""")
def attitude_and_eclipse(spark, sf_dir) -> DataFrame:
    """Satellites on circular orbits at the seconds of all orders: the sun's height over the orbit, nominal yaw, and whether the earth's shadow holds
    them. In SQL the orbit's normal comes from the place a quarter turn ahead."""
    k, w = F.col("o_custkey") % 30, F.col("w")
    x = celestial.with_sun_and_moon(_orders(spark, sf_dir), "ut").withColumn("w", ((F.col("ut") - F.col("o_orderkey") % 86400 + 946728000) % 604800 + F.col("o_orderkey") % 86400).cast("double"))
    speed = math.sqrt(GRAVITY / RADIUS**3)
    at, ahead = circular(k, w, w), circular(k, w + math.pi / 2 / speed, w)  # the velocity points to where it is a quarter turn later
    x = x.withColumns(dict(zip("xyz", at, strict=True)) | {f"v{c}": v * speed for c, v in zip("xyz", ahead, strict=True)})
    x = x.withColumns({"vx": F.col("vx") + SPIN * F.col("y"), "vy": F.col("vy") - SPIN * F.col("x")})  # as seen from the turning earth
    got = celestial.with_attitude(x)
    return got.select("o_orderkey", (F.round(F.degrees("beta"), 5) + 0e0).alias("beta"), (F.round(F.degrees("yaw"), 4) + 0e0).alias("yaw"), "eclipsed")
