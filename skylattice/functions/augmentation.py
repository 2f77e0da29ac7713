"""Delays from satellite-based augmentation: the model troposphere, and grid ionosphere weights, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PI = 3.141592653589793
#: Pressure (mbar), temperature (K), vapour pressure (mbar), lapse rate (K/m) and vapour lapse at latitudes 15 to 75 degrees: averages and seasonal
#: variations (fixed values).
MEAN = ((1013.25, 1017.25, 1015.75, 1011.75, 1013.00), (299.65, 294.15, 283.15, 272.15, 263.65), (26.31, 21.79, 11.66, 6.78, 4.11), (6.30e-3, 6.05e-3, 5.58e-3, 5.39e-3, 4.53e-3), (2.77, 3.15, 2.57, 1.81, 1.55))
SEASON = ((0.0, -3.75, -2.25, -1.75, -0.50), (0.0, 7.00, 11.00, 15.00, 14.50), (0.0, 8.85, 7.24, 5.36, 3.39), (0.0, 0.25e-3, 0.32e-3, 0.81e-3, 0.62e-3), (0.0, 0.33, 0.46, 0.74, 0.30))
K1, K2, RD, GM, G = 77.604, 382000.0, 287.054, 9.784, 9.80665


def _by_latitude(values: tuple[float, ...], deg: Column) -> Column:
    at = F.array(*map(F.lit, values))
    k = F.least(F.greatest(F.floor(deg / 15.0), F.lit(1)), F.lit(4)).cast("int")
    a = F.least(F.greatest(deg / 15.0 - k, F.lit(0.0)), F.lit(1.0))
    return F.element_at(at, k) * (1 - a) + F.element_at(at, k + 1) * a


def with_troposphere(df: DataFrame, name: str, day_of_year: Column, lat: Column, h: Column, el: Column) -> DataFrame:
    """Adds the slant delay (m); 0 below the horizon and out of -100 m to 10 km. Angles in radians. The parameters are columns of a
    projection of their own, so that each is computed once and the generated code stays small."""
    deg = F.abs(lat * 180 / PI)
    c = F.cos(2 * PI * (day_of_year - F.when(lat >= 0, 28.0).otherwise(211.0)) / 365.25)
    names = ("_p", "_t", "_e", "_beta", "_lam")
    x = df.withColumns({"_h": h, "_sin": F.sin(el), "_up": el > 0} | {n: _by_latitude(m, deg) - _by_latitude(s, deg) * c for n, m, s in zip(names, MEAN, SEASON, strict=True)})
    p, t, e, beta, lam = map(F.col, names)
    dry, wet = 1e-6 * K1 * RD * p / GM, 1e-6 * K2 * RD / (GM * (lam + 1) - beta * RD) * e / t
    fall = 1 - beta * F.col("_h") / t
    zenith = dry * F.pow(fall, G / (RD * beta)) + wet * F.pow(fall, (lam + 1) * G / (RD * beta) - 1)
    out = F.when((F.col("_h") < -100) | (F.col("_h") > 1e4) | ~F.col("_up"), F.lit(0.0)).otherwise(zenith * 1.001 / F.sqrt(0.002001 + F.col("_sin") * F.col("_sin")))
    return x.withColumn(name, out).drop(*names, "_h", "_sin", "_up")


def grid_delay(x: Column, y: Column, corner: dict[tuple[int, int], Column]) -> Column:
    """Vertical delay at (x, y) in a unit cell: four present corners bilinear, three by their plane (null outside their triangle), else
    null. A missing corner is null."""
    w = {(0, 0): (1 - x) * (1 - y), (1, 0): x * (1 - y), (0, 1): (1 - x) * y, (1, 1): x * y}
    all_four = sum(w[k] * corner[k] for k in w)
    out = F.when(all_four.isNotNull(), all_four)
    for missing in w:
        i, j = 1 - missing[0], 1 - missing[1]  # the opposite corner is the right angle of the triangle
        u, v = (x if i == 0 else 1 - x), (y if j == 0 else 1 - y)
        plane = (1 - u - v) * corner[i, j] + u * corner[1 - i, j] + v * corner[i, 1 - j]
        out = out.when(corner[missing].isNull() & plane.isNotNull() & (u + v <= 1), plane)
    return out
