"""Corrections of broadcast orbits and clocks, matched by issue and applied to satellites.

A clock correction belongs to the orbit correction of its own issue that was last before it, and that to the ephemeris of its issue. So three kinds of
rows come together by two keys; in batch by two time joins, in a stream by a keyed state (streaming/corrections.py). Rows of
EVENTS: sat, at (time of arrival), kind ('ephemeris', 'orbit' or 'clock'), t0 (s), iod (issue of the correction), iode (issue of the ephemeris),
numbers (orbit.ELEMENTS; or radial, along, across and their rates; or the clock's polynomial, m) and udi, the update interval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy, orbit
from ..kernels import precise
from . import timejoin

EVENTS = "sat long, at timestamp, kind string, t0 double, iod long, iode long, numbers array<double>, udi double"
#: Seconds that a correction holds and that an ephemeris may be away; longest orbit and clock correction, m (fixed values).
AGE, AWAY = 90.0, 7200.0
MOST_ORBIT, MOST_CLOCK = 10.0, 1e-6 * geodesy.C
MATCHED = "sat long, t0 double, iod long, iode long, orbit_t0 double, shift array<double>, orbit_udi double, drift array<double>, clock_udi double, elements array<double>"
#: At or before: the time joins' "before" is strict, so the later time is moved by less than any two times differ.
_HAIR = 1e-6


def matched(events: DataFrame) -> DataFrame:
    """A row for each clock correction that has both its orbit correction, AGE old at most, and its ephemeris. Repeated rows count once."""
    of = lambda kind: events.filter((F.col("kind") == kind) & F.col("t0").isNotNull()).drop("at", "kind").distinct()
    c = of("clock").select("sat", "iod", "t0", F.col("numbers").alias("drift"), F.col("udi").alias("clock_udi"), (F.col("t0") + _HAIR).alias("_t"))
    o = of("orbit").select("sat", "iod", F.col("t0").alias("orbit_t0"), "iode", F.col("numbers").alias("shift"), F.col("udi").alias("orbit_udi"))
    co = timejoin.nearest(c, o, ["sat", "iod"], "_t", "orbit_t0", AGE, [F.col("iode")], before_only=True)
    e = of("ephemeris").select("sat", "iode", F.col("t0").alias("_toe"), F.col("numbers").alias("elements"))
    got = timejoin.nearest(co, e, ["sat", "iode"], "t0", "_toe", AWAY, [F.col("_toe")])
    return got.select(*[c.split()[0] for c in MATCHED.split(", ")])


def _cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _unit(a: tuple[Column, ...]) -> tuple[Column, ...]:
    n = F.sqrt(sum(c * c for c in a))
    return tuple(c / n for c in a)


def with_corrected(df: DataFrame, eph: str, m: Column, sent: str) -> DataFrame:
    """df with struct _s (x, y, z, clock in s) at time `sent` by the ephemeris (a column, struct of ELEMENTS) and the matched row m (a struct);
    null where the correction is longer than corrections may be."""
    kept, when = df.columns, F.col(sent)
    df = orbit.with_satellite(df.withColumns({"_lt": when - 1.0, "_nt": when + 1.0}), eph, {"_l": "_lt", "_h": sent, "_n": "_nt"})
    age = lambda t0, udi: when - m[t0] - F.when(m[udi] >= 1, m[udi] / 2).otherwise(0.0)
    df = df.withColumns({"_a": age("orbit_t0", "orbit_udi"), "_b": age("t0", "clock_udi")})
    a, b = F.col("_a"), F.col("_b")
    df = df.withColumns({f"_d{i}": m["shift"][i] + m["shift"][3 + i] * a for i in range(3)} | {"_drift": m["drift"][0] + b * (m["drift"][1] + b * m["drift"][2])})
    shift, drift = [F.col(f"_d{i}") for i in range(3)], F.col("_drift")
    fits = (F.sqrt(sum(v * v for v in shift)) <= MOST_ORBIT) & (F.abs(drift) <= MOST_CLOCK)
    at, speed = tuple(F.col(f"_h{c}") for c in "xyz"), tuple((F.col(f"_n{c}") - F.col(f"_l{c}")) / 2 for c in "xyz")
    df = df.withColumns({f"_{n}{i}": v for n, axis in (("along", _unit(speed)), ("across", _unit(_cross(at, speed)))) for i, v in enumerate(axis)})
    along, across = (tuple(F.col(f"_{n}{i}") for i in range(3)) for n in ("along", "across"))
    axes = (_cross(along, across), along, across)
    moved = [p - sum(axis[i] * d for axis, d in zip(axes, shift, strict=True)) for i, p in enumerate(at)]
    placed = F.struct(*[v.alias(c) for c, v in zip("xyz", moved, strict=True)], (F.col("_hclock") + drift / geodesy.C).alias("clock"))
    return df.select(*kept, orbit.once(F.when(fits, placed)).alias("_s"))


def with_corrected_satellites(obs: DataFrame, matched: DataFrame) -> DataFrame:
    """obs (with sat, t, p) with sx, sy, sz, sclock (m) by the last matched correction at or before its time and not older than AGE; rows
    without one go."""
    x = timejoin.nearest(obs.filter("p > 0").withColumn("_t", F.col("t") + _HAIR), matched, ["sat"], "_t", "t0", AGE, [F.col("orbit_t0"), F.col("iod")], before_only=True)
    eph = F.struct(*[F.col("elements")[i].alias(c) for i, c in enumerate(orbit.ELEMENTS)])
    m = F.struct(*[c.split()[0] for c in MATCHED.split(", ") if not c.startswith(("sat ", "elements"))])
    x = x.withColumns({"_e": eph, "_m": m}).filter(F.col("t") - F.col("orbit_t0") <= AGE)
    x = x.withColumn("_at", F.col("t") - F.col("p") / geodesy.C).withColumn("_sent", F.col("_at") - orbit.clock(F.col("_e"), F.col("_at")))
    x = with_corrected(x.select(*obs.columns, "_e", "_m", "_sent"), "_e", F.col("_m"), "_sent").filter("_s IS NOT NULL")
    return x.select(*obs.columns, *[F.col(f"_s.{c}").alias(f"s{c}") for c in "xyz"], (F.col("_s.clock") * geodesy.C).alias("sclock"))


POINTS = "srcid long, t double, x double, y double, z double, n int"
#: What the filter takes of a row.
SEEN = ("t", "sat", "sx", "sy", "sz", "sclock", "el", "code", "phase", "slip", "x0", "y0", "z0")


def precise_points(obs: DataFrame) -> DataFrame:
    """POINTS by the filter of ionosphere-free combinations, a group for each source. obs: srcid, t, sat, code and phase (m, ionosphere-free), slip,
    sx, sy, sz, sclock (m), and x0, y0, z0, the source's place to some metres."""
    here, there = tuple(F.col(f"{c}0") for c in "xyz"), tuple(F.col(f"s{c}") for c in "xyz")
    lat, lon, _ = geodesy.position(*here)
    el = geodesy.elevation(F.col("_lat"), F.col("_lon"), tuple(p - q for p, q in zip(there, here, strict=True)))

    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in POINTS.split(", ")])

    def solve(table: pa.Table) -> pa.Table:
        c = {k: table[k].to_numpy() for k in SEEN}
        order = np.lexsort((c["sat"], c["t"]))
        c = {k: v[order] for k, v in c.items()}
        where, slip, clock = np.stack([c["sx"], c["sy"], c["sz"]], axis=1), c["slip"].astype(bool), c["sclock"] / geodesy.C
        starts = np.flatnonzero(np.diff(c["t"], prepend=np.nan) != 0).tolist()
        f, out = precise.PointFilter(np.array([c["x0"][0], c["y0"][0], c["z0"][0]])), []
        for i, j in zip(starts, [*starts[1:], len(order)], strict=True):
            if f.epoch(c["sat"][i:j], where[i:j], clock[i:j], c["el"][i:j], c["code"][i:j], c["phase"][i:j], slip[i:j]):
                out.append((table["srcid"][0].as_py(), float(c["t"][i]), *map(float, f.position), j - i))
        return pa.Table.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema=schema)

    return obs.withColumns({"_lat": lat, "_lon": lon}).withColumn("el", el).select("srcid", *SEEN).groupBy("srcid").applyInArrow(solve, POINTS)
