"""Sun and moon, solid tides, and the attitude and eclipses of satellites, as columns. Metres, radians, seconds.

The positions are the low-precision series of almanacs: angles that grow with time, and few harmonics of them. Their terms are tables here, from which the
columns are made; angles are reduced to a turn before their sines are taken, so that no digits are lost."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees at 2000-01-01 12:00 and per day (fixed values): anomaly and longitude of the sun; longitude, anomaly, argument of latitude and elongation of the
#: moon; tilt of the ecliptic; sidereal angle.
ANGLES = {
    "g": (357.5277233, 0.98560028), "q": (280.460, 0.9856474), "lm": (218.316, 13.176396), "mm": (134.963, 13.064993), "fm": (93.272, 13.229350), "em": (297.850, 12.190749),
    "tilt": (23.439291, -3.56e-7), "turn": (280.46061837, 360.98564736629),
}
#: Harmonics: amplitude and multiples of angles; degrees by sines for longitudes and latitude, metres by cosines for distances (fixed values).
SUN_LON = ((1.915, {"g": 1}), (0.020, {"g": 2}))
SUN_FAR = (1.495978707e11 * 1.000140612, ((-1.495978707e11 * 0.016708617, {"g": 1}), (-1.495978707e11 * 0.000139589, {"g": 2})))
MOON_LON = ((6.289, {"mm": 1}), (1.274, {"em": 2, "mm": -1}), (0.658, {"em": 2}))
MOON_LAT = ((5.128, {"fm": 1}),)
MOON_FAR = (385001000.0, ((-20905000.0, {"mm": 1}), (-3699000.0, {"em": 2, "mm": -1}), (-2956000.0, {"em": 2})))
#: Gravity of sun, moon and earth, and the degree-2 numbers of the solid earth (fixed values).
MU_SUN, MU_MOON, MU_EARTH, H2, L2 = 1.32712440018e20, 4.902801e12, 3.986004415e14, 0.6078, 0.0847
TURN, EARTH = math.pi / 180, 6378137.0
Triple = tuple[Column, Column, Column]


def _angle(terms: dict[str, int]) -> Column:
    return sum(F.col(f"_{k}") * n for k, n in terms.items())


def with_sun_and_moon(df: DataFrame, t: str) -> DataFrame:
    """df with sun_x.. and moon_x.., earth-fixed; t: seconds of universal time since 2000-01-01 12:00."""
    kept = df.columns
    day = F.col(t) / 86400.0
    turned = {k: a + b * day for k, (a, b) in ANGLES.items()}
    x = df.withColumns({f"_{k}": (v - 360.0 * F.floor(v / 360.0)) * TURN for k, v in turned.items()})
    wave = lambda terms, f: sum(a * f(_angle(k)) for a, k in terms)
    x = x.withColumns({
        "_ls": F.col("_q") + TURN * wave(SUN_LON, F.sin), "_rs": SUN_FAR[0] + wave(SUN_FAR[1], F.cos), "_bm": TURN * wave(MOON_LAT, F.sin), "_lo": F.col("_lm") + TURN * wave(MOON_LON, F.sin),
        "_rm": MOON_FAR[0] + wave(MOON_FAR[1], F.cos),
    })
    c, s = F.cos("_tilt"), F.sin("_tilt")
    my, mz = F.cos("_bm") * F.sin("_lo"), F.sin("_bm")
    x = x.withColumns({
        "_sx": F.col("_rs") * F.cos("_ls"), "_sy": F.col("_rs") * c * F.sin("_ls"), "_sz": F.col("_rs") * s * F.sin("_ls"),
        "_mx": F.col("_rm") * F.cos("_bm") * F.cos("_lo"), "_my": F.col("_rm") * (c * my - s * mz), "_mz": F.col("_rm") * (s * my + c * mz),
    })
    c, s = F.cos("_turn"), F.sin("_turn")
    fixed = {f"{n}_{a}": v for n, p in (("sun", "s"), ("moon", "m")) for a, v in zip("xyz", (c * F.col(f"_{p}x") + s * F.col(f"_{p}y"), -s * F.col(f"_{p}x") + c * F.col(f"_{p}y"), F.col(f"_{p}z")), strict=True)}
    return x.withColumns(fixed).select(*kept, *fixed)


def dot(a: Triple, b: Triple) -> Column:
    return sum(p * q for p, q in zip(a, b, strict=True))


def cross(a: Triple, b: Triple) -> Triple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def with_solid_tide(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """df (with sun_x.. and moon_x..) with tide_x.., the displacement of the site by the degree-2 tides of both bodies."""
    kept, site = df.columns, (F.col(x), F.col(y), F.col(z))
    r = df.withColumn("_r", F.sqrt(dot(site, site)))
    for n in ("sun", "moon"):
        body = tuple(F.col(f"{n}_{a}") for a in "xyz")
        r = r.withColumn(f"_d{n}", F.sqrt(dot(body, body))).withColumn(f"_c{n}", dot(site, body) / (F.col("_r") * F.col(f"_d{n}")))
    out = {}
    for i, a in enumerate("xyz"):
        out[f"tide_{a}"] = sum(
            mu / MU_EARTH * F.pow("_r", F.lit(4)) / F.pow(F.col(f"_d{n}"), 3) * (H2 * site[i] / F.col("_r") * (1.5 * F.col(f"_c{n}") * F.col(f"_c{n}") - 0.5) + 3 * L2 * F.col(f"_c{n}") * (F.col(f"{n}_{a}") / F.col(f"_d{n}") - F.col(f"_c{n}") * site[i] / F.col("_r")))
            for n, mu in (("sun", MU_SUN), ("moon", MU_MOON))
        )
    return r.withColumns(out).select(*kept, *out)


def with_attitude(df: DataFrame, spin: float = 7.2921151467e-5) -> DataFrame:
    """df (satellite x, y, z and velocity vx, vy, vz, earth-fixed, and sun_x..) with beta (the sun's height over the orbit), yaw (nominal, 0 to 2 pi), the satellite's
    axes ex_x.., ey_x.., and eclipsed: the satellite is behind the earth and in its cylinder of shadow."""
    kept, r, sun = df.columns, tuple(F.col(c) for c in "xyz"), tuple(F.col(f"sun_{c}") for c in "xyz")
    v = (F.col("vx") - spin * F.col("y"), F.col("vy") + spin * F.col("x"), F.col("vz"))
    triple = lambda name: tuple(F.col(f"_{name}{c}") for c in "xyz")
    put = lambda df, name, t: df.withColumns({f"_{name}{c}": p for c, p in zip("xyz", t, strict=True)})
    unit = lambda df, name: put(df.withColumn(f"_{name}", F.sqrt(dot(triple(name), triple(name)))), f"e{name}", tuple(c / F.col(f"_{name}") for c in triple(name)))
    x = df
    for name, t in (("r", r), ("s", sun), ("n", cross(r, v))):
        x = unit(put(x, name, t), name)
    x = unit(put(x, "p", cross(sun, triple("n"))), "p")
    x = put(x, "ex", cross(triple("en"), triple("er")))
    x = x.withColumn("beta", F.asin(dot(triple("es"), triple("en")))).withColumn("_up", dot(triple("er"), triple("es")))
    x = x.withColumn("yaw", F.atan2(-F.tan("beta"), dot(triple("er"), triple("ep"))) + math.pi)
    x = x.withColumn("eclipsed", (F.col("_up") < 0) & (F.col("_r") * F.sqrt(1 - F.col("_up") * F.col("_up")) <= EARTH))
    c, s = F.cos("yaw"), F.sin("yaw")
    axes = {f"ex_{a}": -s * n + c * e for a, n, e in zip("xyz", triple("en"), triple("ex"), strict=True)} | {f"ey_{a}": -c * n - s * e for a, n, e in zip("xyz", triple("en"), triple("ex"), strict=True)}
    return x.withColumns(axes).select(*kept, "beta", "yaw", "eclipsed", *axes)
