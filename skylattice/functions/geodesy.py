"""Geodesy as columns: ellipsoid, local frames, ranges and directions. Angles are radians, lengths metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84, earth rotation (rad/s) and the speed of light (m/s): fixed values.
RE, FLAT, OMEGA, C = 6378137.0, 1 / 298.257223563, 7.2921151467e-5, 299792458.0
E2 = FLAT * (2 - FLAT)
Triple = tuple[Column, Column, Column]


def ecef(lat: Column, lon: Column, h: Column) -> Triple:
    v = F.lit(RE) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return (v + h) * F.cos(lat) * F.cos(lon), (v + h) * F.cos(lat) * F.sin(lon), (v * (1 - E2) + h) * F.sin(lat)


def position(x: Column, y: Column, z: Column, steps: int = 6) -> Triple:
    """Latitude, longitude, height by a fixed number of fixed-point steps; poles by sign of z, as there is no longitude."""
    r2 = x * x + y * y
    state = F.struct(z.alias("z"), F.lit(RE).alias("v"))

    def step(s: Column, _: Column) -> Column:
        sin = s["z"] / F.sqrt(r2 + s["z"] * s["z"])
        v = F.lit(RE) / F.sqrt(1 - E2 * sin * sin)
        return F.struct((z + v * E2 * sin).alias("z"), v.alias("v"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)
    off_axis = r2 > 1e-12
    lat = F.when(off_axis, F.atan(end["z"] / F.sqrt(r2))).otherwise(F.signum(z) * F.lit(1.5707963267948966))
    lon = F.when(off_axis, F.atan2(y, x)).otherwise(F.lit(0.0))
    return lat, lon, F.sqrt(r2 + end["z"] * end["z"]) - end["v"]


def sines(lat: Column, lon: Column) -> tuple[Column, Column, Column, Column]:
    """What turned() takes of a place: worth a column of its own where a place meets many vectors."""
    return F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)


def to_enu(lat: Column, lon: Column, d: Triple) -> Triple:
    """Difference vector d in east, north, up at lat, lon."""
    return turned(sines(lat, lon), d)


def turned(of: tuple[Column, Column, Column, Column], d: Triple) -> Triple:
    """Difference vector d in east, north, up at the place of these sines()."""
    sp, cp, sl, cl = of
    x, y, z = d
    return -sl * x + cl * y, -sp * cl * x - sp * sl * y + cp * z, cp * cl * x + cp * sl * y + sp * z


def from_enu(lat: Column, lon: Column, e: Triple) -> Triple:
    sp, cp, sl, cl = F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)
    e, n, u = e
    return -sl * e - sp * cl * n + cp * cl * u, cl * e - sp * sl * n + cp * sl * u, cp * n + sp * u


def distance(a: Triple, b: Triple) -> Column:
    return F.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b, strict=True)))


def geometric_range(sat: Triple, rcv: Triple) -> Column:
    """Range with the correction for the earth's rotation; null inside the earth."""
    rs = F.sqrt(sat[0] * sat[0] + sat[1] * sat[1] + sat[2] * sat[2])
    return F.when(rs >= RE, distance(sat, rcv) + OMEGA * (sat[0] * rcv[1] - sat[1] * rcv[0]) / C)


def elevation(lat: Column, lon: Column, d: Triple) -> Column:
    """Elevation of the difference vector d over the ellipsoid's horizon at lat, lon; each part of d is used twice only."""
    up = d[0] * F.cos(lat) * F.cos(lon) + d[1] * F.cos(lat) * F.sin(lon) + d[2] * F.sin(lat)
    return F.asin(up / F.sqrt(sum(c * c for c in d)))


def direction(enu: Triple) -> tuple[Column, Column]:
    """Azimuth in [0, 2 pi) and elevation of an east, north, up vector."""
    e, n, u = enu
    size = F.sqrt(e * e + n * n + u * u)
    az = F.when(e * e + n * n < 1e-12 * size * size, F.lit(0.0)).otherwise(F.atan2(e, n))
    return F.when(az < 0, az + 6.283185307179586).otherwise(az), F.asin(u / size)


def dms(angle: Column) -> tuple[Column, Column, Column]:
    """Degrees (signed), minutes, seconds to 1e-6 with the carry done first; angle in degrees."""
    units = F.round(F.abs(angle) * 3600e6).cast("long")
    sign = F.when(angle < 0, -1).otherwise(1)
    return sign * F.floor(units / 3600000000).cast("long"), F.floor(units / 60000000).cast("long") % 60, (units % 60000000) / 1e6
