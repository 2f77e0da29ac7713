"""Ionosphere and troposphere delays as columns (radians, metres)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793
#: Broadcast ionosphere coefficients of 2004-01-01, used where none are given (fixed values).
DEFAULT_ION = (0.1118e-07, -0.7451e-08, -0.5961e-07, 0.1192e-06, 0.1167e06, -0.2294e06, -0.1311e06, 0.1049e07)


def klobuchar(tow: Column, lat: Column, lon: Column, az: Column, el: Column, ion: tuple = DEFAULT_ION) -> Column:
    """Delay on the first frequency; 0 below the horizon."""
    psi = 0.0137 / (el / PI + 0.11) - 0.022
    phi = F.least(F.greatest(lat / PI + psi * F.cos(az), F.lit(-0.416)), F.lit(0.416))
    lam = lon / PI + psi * F.sin(az) / F.cos(phi * PI)
    phi = phi + 0.064 * F.cos((lam - 1.617) * PI)
    t = 43200.0 * lam + tow
    t = t - F.floor(t / 86400.0) * 86400.0
    slant = 1 + 16.0 * F.pow(0.53 - el / PI, F.lit(3.0))
    cubic = lambda k: ion[k] + phi * (ion[k + 1] + phi * (ion[k + 2] + phi * ion[k + 3]))
    amp, per = F.greatest(cubic(0), F.lit(0.0)), F.greatest(cubic(4), F.lit(72000.0))
    x = 2 * PI * (t - 50400.0) / per
    wave = F.when(F.abs(x) < 1.57, 5e-9 + amp * (1 + x * x * (-0.5 + x * x / 24.0))).otherwise(F.lit(5e-9))
    return F.when(el <= 0, F.lit(0.0)).otherwise(299792458.0 * slant * wave)


def saastamoinen(lat: Column, h: Column, el: Column, humidity: float = 0.7) -> Column:
    """Standard atmosphere; 0 outside -100 m to 10 km and below the horizon."""
    up = F.greatest(h, F.lit(0.0))
    p = 1013.25 * F.pow(1 - 2.2557e-5 * up, F.lit(5.2568))
    t = 15.0 - 6.5e-3 * up + 273.16
    e = 6.108 * humidity * F.exp((17.15 * t - 4684.0) / (t - 38.45))
    z = PI / 2 - el
    dry = 0.0022768 * p / (1 - 0.00266 * F.cos(2 * lat) - 0.00028 * up / 1e3) / F.cos(z)
    wet = 0.002277 * (1255.0 / t + 0.05) * e / F.cos(z)
    return F.when((h < -100) | (h > 1e4) | (el <= 0), F.lit(0.0)).otherwise(dry + wet)


def ion_mapping(h: Column, el: Column, layer: float = 350000.0, re: float = 6378137.0) -> Column:
    return F.when(h >= layer, F.lit(1.0)).otherwise(1 / F.cos(F.asin((re + h) / (re + layer) * F.cos(el))))


#: Niell's coefficients a, b, c by latitude 15 to 75 degrees: dry mean, dry seasonal amplitude, wet; and of height (fixed values).
DRY_MEAN = ((1.2769934e-3, 1.2683230e-3, 1.2465397e-3, 1.2196049e-3, 1.2045996e-3), (2.9153695e-3, 2.9152299e-3, 2.9288445e-3, 2.9022565e-3, 2.9024912e-3), (62.610505e-3, 62.837393e-3, 63.721774e-3, 63.824265e-3, 64.258455e-3))
DRY_SEASON = ((0.0, 1.2709626e-5, 2.6523662e-5, 3.4000452e-5, 4.1202191e-5), (0.0, 2.1414979e-5, 3.0160779e-5, 7.2562722e-5, 11.723375e-5), (0.0, 9.0128400e-5, 4.3497037e-5, 84.795348e-5, 170.37206e-5))
WET = ((5.8021897e-4, 5.6794847e-4, 5.8118019e-4, 5.9727542e-4, 6.1641693e-4), (1.4275268e-3, 1.5138625e-3, 1.4572752e-3, 1.5007428e-3, 1.7599082e-3), (4.3472961e-2, 4.6729510e-2, 4.3908931e-2, 4.4626982e-2, 5.4736038e-2))
HEIGHT = (2.53e-5, 5.49e-3, 1.14e-3)


def _by_latitude(values: tuple[float, ...], deg: Column) -> Column:
    k = F.least(F.greatest(F.floor(deg / 15.0), F.lit(1)), F.lit(4)).cast("int")
    at = F.array(*map(F.lit, values))
    a = F.least(F.greatest(deg / 15.0 - k, F.lit(0.0)), F.lit(1.0))
    return F.element_at(at, k) * (1 - a) + F.element_at(at, k + 1) * a


def _fraction(sin: Column, a: Column, b: Column, c: Column) -> Column:
    return (1 + a / (1 + b / (1 + c))) / (sin + a / (sin + b / (sin + c)))


def niell(day_of_year: Column, lat: Column, h: Column, el: Column) -> tuple[Column, Column]:
    """Dry and wet mapping."""
    deg = F.abs(lat * 180 / PI)
    phase = (day_of_year - 28.0) / 365.25 + F.when(lat < 0, 0.5).otherwise(0.0)
    season, sin = F.cos(2 * PI * phase), F.sin(el)
    dry = [_by_latitude(m, deg) - _by_latitude(s, deg) * season for m, s in zip(DRY_MEAN, DRY_SEASON, strict=True)]
    height = (1 / sin - _fraction(sin, *map(F.lit, HEIGHT))) * h / 1e3
    return _fraction(sin, *dry) + height, _fraction(sin, *(_by_latitude(w, deg) for w in WET))
