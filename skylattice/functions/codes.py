"""Satellite ids, signal frequencies and error models as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: System letter, number of the first satellite, of satellites, and what is added to a number for its text (fixed values).
SYSTEMS = (("G", 1, 32, 0), ("R", 33, 27, 0), ("E", 60, 36, 0), ("J", 96, 10, 0), ("C", 106, 63, 0))


def sat_name(sat: Column) -> Column:
    out = F.lit(None).cast("string")
    for letter, first, n, _ in reversed(SYSTEMS):
        out = F.when((sat >= first) & (sat < first + n), F.concat(F.lit(letter), F.lpad((sat - first + 1).cast("string"), 2, "0"))).otherwise(out)
    return out


def sat_number(name: Column) -> Column:
    prn = F.substring(name, 2, 3).try_cast("int")
    out = F.lit(None).cast("long")
    for letter, first, n, _ in SYSTEMS:
        out = F.when((F.substring(name, 1, 1) == letter) & (prn >= 1) & (prn <= n), (prn + first - 1).cast("long")).otherwise(out)
    return out


#: Band digit of a signal code -> MHz by system (fixed values); GLONASS adds a step for each channel on bands 1 and 2.
BANDS = {
    "G": {"1": 1575.42, "2": 1227.60, "5": 1176.45}, "E": {"1": 1575.42, "5": 1176.45, "7": 1207.14, "6": 1278.75, "8": 1191.795},
    "J": {"1": 1575.42, "2": 1227.60, "5": 1176.45, "6": 1278.75}, "C": {"1": 1575.42, "2": 1561.098, "7": 1207.14, "6": 1268.52, "5": 1176.45, "8": 1191.795},
    "R": {"1": 1602.0, "2": 1246.0, "3": 1202.025},
}
GLONASS_STEP = {"1": 0.5625, "2": 0.4375}


def frequency(system: Column, code: Column, channel: Column) -> Column:
    """Hz; null where the system has no such band."""
    out, band = F.lit(None).cast("double"), F.substring(code, 1, 1)
    for letter, bands in BANDS.items():
        for digit, mhz in bands.items():
            f = F.lit(mhz * 1e6) + (channel * GLONASS_STEP[digit] * 1e6 if letter == "R" and digit in GLONASS_STEP else 0)
            out = F.when((system == letter) & (band == digit), f).otherwise(out)
    return out


def wavelength_mhz(mhz: float) -> float:
    return 299.792458 / mhz


def spp_variance(el: Column, factor: Column, err: tuple[float, float, float] = (100.0, 0.003, 0.003), iono_free: bool = False) -> Column:
    """Pseudorange variance; elevation in radians, floored at 5 degrees."""
    el = F.greatest(el, F.lit(5 * 3.141592653589793 / 180))
    return factor * factor * (err[0] ** 2) * (err[1] ** 2 + err[2] ** 2 / F.sin(el)) * (9 if iono_free else 1)


def rtk_variance(el: Column, baseline: Column, dt: Column, factor: Column, err: tuple[float, float, float] = (0.003, 0.003, 0.0), clock: float = 5e-12) -> Column:
    """Single-difference variance: elevation in radians, baseline in metres, dt the time between the two receivers."""
    a, b, c, d = factor * err[0], factor * err[1], err[2] * baseline / 1e4, 299792458.0 * clock * dt
    sin = F.sin(el)
    return 2 * (a * a + b * b / sin / sin + c * c) + d * d


def iono_free(p1: Column, p2: Column, f1: float, f2: float) -> Column:
    g = (f1 / f2) ** 2
    return (p2 - g * p1) / (1 - g)


def melbourne_wubbena(l1: Column, l2: Column, p1: Column, p2: Column, w1: float, w2: float) -> Column:
    """Phases in cycles, ranges and wavelengths in metres."""
    return w1 * w2 * (l1 - l2) / (w2 - w1) - (w2 * p1 + w1 * p2) / (w2 + w1)


def geometry_free(l1: Column, l2: Column, w1: float, w2: float) -> Column:
    return l1 * w1 - l2 * w2
