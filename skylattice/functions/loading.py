"""Displacement of sites by ocean loading and by the motion of the pole, as columns east, north, up in metres.

Time is seconds of universal time since 2000-01-01 12:00, as in `celestial`."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Constituents in the order of loading files (fixed values): rad/s; multiples of the mean longitudes of sun and moon and of the moon's
#: perigee; turns.
WAVES = (
    ("M2", 1.40519e-4, 2, -2, 0, 0.0), ("S2", 1.45444e-4, 0, 0, 0, 0.0), ("N2", 1.37880e-4, 2, -3, 1, 0.0), ("K2", 1.45842e-4, 2, 0, 0, 0.0),
    ("K1", 0.72921e-4, 1, 0, 0, 0.25), ("O1", 0.67598e-4, 1, -2, 0, -0.25), ("P1", 0.72523e-4, -1, 0, 0, -0.25), ("Q1", 0.64959e-4, 1, -3, 1, -0.25),
    ("Mf", 0.53234e-5, 0, 2, 0, 0.0), ("Mm", 0.26392e-5, 0, 1, -1, 0.0), ("Ssa", 0.03982e-5, 2, 0, 0, 0.0),
)
#: Mean longitudes in degrees by powers of centuries since 1900 (fixed values).
SUN, MOON, PERIGEE = (279.69668, 36000.768930485, 3.03e-4), (270.434358, 481267.88314137, -0.001133, 1.9e-6), (334.329653, 4069.0340329577, -0.010325, -1.2e-5)
#: Mean pole in milliseconds of arc by powers of years since 2000: before 2010, then after (fixed values).
POLE_X = ((55.974, 1.8243, 0.18413, 0.007024), (23.513, 7.6141))
POLE_Y = ((346.346, 1.7896, -0.10729, -0.000908), (358.891, -0.6287))
#: Days from 1975-01-01 to 2000-01-01; days after 2000.0 at which the mean pole changes its form.
SINCE_1975, CHANGE = 9131, 3653.0


def _powers(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def with_ocean_loading(df: DataFrame, t: str, waves: str) -> DataFrame:
    """df with ocean_e, ocean_n, ocean_u. waves: an array, in the order of WAVES, of structs up, west, south (metres) and up_lag, west_lag,
    south_lag (degrees). Null, or with null members: null."""
    kept = df.columns
    since = F.col(t) + 43200.0
    day = F.floor(since / 86400.0)
    century = (27392.500528 + 1.000000035 * (day + SINCE_1975 + 1)) / 36525.0
    x = df.withColumns({"_s": since - day * 86400.0} | {f"_{n}": F.radians(_powers(c, century)) for n, c in (("h", SUN), ("m", MOON), ("p", PERIGEE))})
    angle = F.array(*[F.col("_s") * v + F.col("_h") * h + F.col("_m") * m + F.col("_p") * p + 2 * math.pi * turn for _, v, h, m, p, turn in WAVES])
    x = x.withColumn("_a", angle)

    def total(name: str, sign: int) -> Column:
        each = F.zip_with(F.col(waves), F.col("_a"), lambda w, a: w[name] * F.cos(a - F.radians(w[f"{name}_lag"])))
        return F.aggregate(each, F.lit(0.0), lambda s, v: s + v) * sign

    return x.select(*[F.col(f"`{c}`") for c in kept], total("west", -1).alias("ocean_e"), total("south", -1).alias("ocean_n"), total("up", 1).alias("ocean_u"))


def with_pole_tide(df: DataFrame, t: str, lat: str, lon: str, xp: str, yp: str) -> DataFrame:
    """df with pole_e, pole_n, pole_u; lat, lon in radians, the pole's place xp, yp in seconds of arc."""
    days = (F.col(t) + 43200.0) / 86400.0
    mean = lambda v: F.when(days < CHANGE, _powers(v[0], days / 365.25)).otherwise(_powers(v[1], days / 365.25)) / 1000.0
    m1, m2 = F.col(xp) - mean(POLE_X), mean(POLE_Y) - F.col(yp)
    along, across = m1 * F.cos(lon) + m2 * F.sin(lon), m1 * F.sin(lon) - m2 * F.cos(lon)
    return df.withColumns({"pole_e": 0.009 * F.sin(lat) * across, "pole_n": -0.009 * F.cos(2 * F.col(lat)) * along, "pole_u": -0.033 * F.sin(2 * F.col(lat)) * along})
