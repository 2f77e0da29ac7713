"""Integers of three frequencies by a cascade, from the longest combination to the shortest, in columns.

Double differences of one satellite pair are averaged over an arc, in which neither satellite slips on either band. The difference of the two lower
frequencies has waves of metres and is rounded against ranges; with that integer its phases are a better range, against which the difference of
the upper two is rounded, and so on to the first frequency itself. Each step takes the variance of the one before: of the ranges, then of the
phases in its combination. A step counts if its chance of being rounded right passes RATE; those after a step that doesn't, don't count either.

The shuffles are by base line, satellite and epoch for the arcs and the reference satellite, and by pair and arc for the means, which combine before."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = 299792458.0
RATE = 0.999


def erf(x: Column) -> Column:
    """The error function for x >= 0, within 1.5e-7 (a rational approximation that is in handbooks)."""
    t = 1 / (1 + 0.3275911 * x)
    return 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def rounded_right(sigma: Column) -> Column:
    """Chance that a number with this standard deviation is rounded to the integer that it is near."""
    return F.when(sigma <= 0, 1.0).otherwise(erf(1 / (2 * math.sqrt(2) * sigma)))


def with_arcs(diff: DataFrame) -> DataFrame:
    """A row for each base line, epoch and satellite with all three bands: p0 to p2 (m), l0 to l2 (cycles), spread (the noise factor) and arc, the number of slips so far."""
    g = diff.groupBy("baseline", "epoch", "sat").agg(
        *[F.max(F.when(F.col("band") == b, F.col(v))).alias(f"{n}{b}") for b in range(3) for v, n in (("code", "p"), ("phase", "l"))],
        F.max(F.col("slip").cast("int")).alias("slip"), F.max(F.col("factor") * F.sqrt(1 + 1 / F.pow(F.sin("el"), 2))).alias("spread"),
    )
    g = g.filter(" AND ".join(f"{n}{b} IS NOT NULL" for n in "pl" for b in range(3)))
    w = Window.partitionBy("baseline", "sat").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("arc", F.sum("slip").over(w))


def pairs(x: DataFrame) -> DataFrame:
    """Double differences against the satellite with the least noise of each epoch (the lower number of equal ones)."""
    best = F.min(F.struct("spread", "sat", "arc", *[f"{n}{b}" for n in "pl" for b in range(3)])).over(Window.partitionBy("baseline", "epoch"))
    y = x.withColumn("_r", best).filter(F.col("sat") != F.col("_r.sat"))
    dd = [(F.col(f"{n}{b}") - F.col(f"_r.{n}{b}")).alias(f"{n}{b}") for n in "pl" for b in range(3)]
    return y.select("baseline", "epoch", "sat", "arc", F.col("_r.sat").alias("ref"), F.col("_r.arc").alias("ref_arc"), (F.col("spread") * F.col("spread") + F.col("_r.spread") * F.col("_r.spread")).alias("v"), *dd)


def cascade(diff: DataFrame, frequencies: tuple[float, float, float], noise: tuple[float, float] = (0.3, 0.003)) -> DataFrame:
    """baseline, sat, ref, arc, ref_arc, n (epochs), last (of them), n0, n1, n2 (integers of the bands; null where a step isn't sure). diff: DIFFERENCES of baselines.py with the rover's range still in,
    frequencies falling (Hz), noise of codes and phases (m)."""
    f = frequencies
    wave = [C / v for v in f]
    wide = {(0, 1): C / (f[0] - f[1]), (1, 2): C / (f[1] - f[2])}
    keys = ["baseline", "sat", "ref", "arc", "ref_arc"]
    mean = pairs(with_arcs(diff)).groupBy(*keys).agg(F.count("*").alias("n"), F.max("epoch").alias("last"), F.avg("v").alias("v"), *[F.avg(f"{n}{b}").alias(f"{n}{b}") for n in "pl" for b in range(3)])
    per = F.sqrt(F.col("v") / F.col("n"))  # noise factor of a mean
    # metres: codes in the combination whose ionosphere is that of the phases' difference
    code = (f[1] * F.col("p1") + f[2] * F.col("p2")) / (f[1] + f[2])
    code_noise = noise[0] * math.hypot(f[1], f[2]) / (f[1] + f[2])
    x = mean.withColumn("a2", F.col("l1") - F.col("l2") - code / wide[1, 2]).withColumn("s2", per * math.hypot(code_noise, noise[1] * math.hypot(1 / wave[1], 1 / wave[2]) * wide[1, 2]) / wide[1, 2])
    x = x.withColumn("m2", F.round("a2").cast("long"))
    # its phases as a range, in metres
    r2, r2_noise = wide[1, 2] * (F.col("l1") - F.col("l2") - F.col("m2")), noise[1] * wide[1, 2] * math.hypot(1 / wave[1], 1 / wave[2])
    x = x.withColumn("a1", F.col("l0") - F.col("l1") - r2 / wide[0, 1]).withColumn("s1", per * math.hypot(r2_noise, noise[1] * wide[0, 1] * math.hypot(1 / wave[0], 1 / wave[1])) / wide[0, 1])
    x = x.withColumn("m1", F.round("a1").cast("long"))
    r1, r1_noise = wide[0, 1] * (F.col("l0") - F.col("l1") - F.col("m1")), noise[1] * wide[0, 1] * math.hypot(1 / wave[0], 1 / wave[1])
    x = x.withColumn("a0", F.col("l0") - r1 / wave[0]).withColumn("s0", per * math.hypot(r1_noise, noise[1]) / wave[0]).withColumn("m0", F.round("a0").cast("long"))
    sure = {k: (rounded_right(F.col(f"s{k}")) >= RATE) & (F.abs(F.col(f"a{k}") - F.col(f"m{k}")) <= F.least(F.lit(0.4), F.greatest(4 * F.col(f"s{k}"), F.lit(0.05)))) for k in (2, 1, 0)}
    ok = sure[2] & sure[1] & sure[0]
    n0 = F.when(ok, F.col("m0"))
    return x.select(*keys, "n", "last", n0.alias("n0"), (n0 - F.when(ok, F.col("m1"))).alias("n1"), (n0 - F.when(ok, F.col("m1")) - F.when(ok, F.col("m2"))).alias("n2"), F.when(sure[2], F.col("m2")).alias("extra_wide"), F.when(sure[2] & sure[1], F.col("m1")).alias("wide"))
