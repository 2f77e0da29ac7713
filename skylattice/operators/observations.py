"""Observation tables: screening, differences, slips, counters, outliers, and small statistics.

Observation columns: srcid, epoch, sat, grp (system), p, l, el (degrees), snr.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snr_mask(el: Column, mask: list[float]) -> Column:
    """Least signal strength at an elevation in degrees: nine values at 5, 15, ... 85, linear between, constant outside."""
    at = F.array(*map(F.lit, mask))
    a = (el + 5.0) / 10.0
    i = F.floor(a)
    a = a - i
    inner = (1 - a) * F.element_at(at, F.greatest(F.least(i, F.lit(8)), F.lit(1)).cast("int")) + a * F.element_at(at, F.greatest(F.least(i + 1, F.lit(9)), F.lit(1)).cast("int"))
    return F.when(i < 1, F.lit(mask[0])).when(i > 8, F.lit(mask[8])).otherwise(inner)


def excluded(health: Column, listed: Column, variance: Column, is_qzss: Column) -> Column:
    """Satellite exclusion: listed 1 drops, 2 keeps; else bad health, or a variance over 300 m squared."""
    bad = F.when(is_qzss, health.bitwiseAND(F.lit(0xFE)) != 0).otherwise(health != 0)
    return F.when(health < 0, True).when(listed == 1, True).when(listed == 2, False).otherwise(bad | (variance > 300.0 * 300.0))


def single_differences(obs: DataFrame, pairs: DataFrame, mask: float) -> DataFrame:
    """Rover minus base on common satellites with the base's elevation over the mask. pairs: rover, base. A null or
    zero on either side gives 0."""
    r = obs.select(F.col("srcid").alias("rover"), "epoch", "sat", "grp", F.col("p").alias("_pr"), F.col("l").alias("_lr"), "el")
    b = obs.filter(F.col("el") >= mask).select(F.col("srcid").alias("base"), "epoch", "sat", F.col("p").alias("_pb"), F.col("l").alias("_lb"))
    j = r.join(pairs, "rover").join(b, ["base", "epoch", "sat"])
    diff = lambda x, y: F.when((F.coalesce(x, F.lit(0.0)) == 0) | (F.coalesce(y, F.lit(0.0)) == 0), F.lit(0.0)).otherwise(x - y)
    return j.select("rover", "base", "epoch", "sat", "grp", "el", diff(F.col("_pr"), F.col("_pb")).alias("sdp"), diff(F.col("_lr"), F.col("_lb")).alias("sdl"))


def double_differences(sd: DataFrame) -> DataFrame:
    """Against the highest satellite of each base line, epoch and system (the later one of equal)."""
    w = Window.partitionBy("rover", "base", "epoch", "grp")
    ref = F.max(F.struct("el", "sat", "sdp", "sdl")).over(w)
    x = sd.withColumn("_r", ref).filter(F.col("sat") != F.col("_r.sat"))
    packed = F.shiftleft(F.col("_r.sat"), 16).bitwiseOR(F.shiftleft(F.col("sat"), 8))
    return x.select("rover", "base", "epoch", "grp", "sat", F.col("_r.sat").alias("ref"), (F.col("sdp") - F.col("_r.sdp")).alias("ddp"), (F.col("sdl") - F.col("_r.sdl")).alias("ddl"), packed.alias("vflg"))


def mad_outliers(df: DataFrame, keys: list[str], value: str, limit: float = 3.0, scale: float = 1.4826) -> DataFrame:
    """Adds med, mad and outlier: over `limit` scaled median deviations from the median, in groups of three and more."""
    w = Window.partitionBy(*keys)
    x = df.withColumn("med", F.median(value).over(w)).withColumn("_n", F.count("*").over(w))
    x = x.withColumn("mad", F.median(F.abs(F.col(value) - F.col("med"))).over(w))
    far = F.abs((F.col(value) - F.col("med")) / (scale * F.col("mad"))) >= limit
    return x.withColumn("outlier", (F.col("_n") >= 3) & (F.col("mad") > 0) & F.coalesce(far, F.lit(False))).drop("_n")


def slips(series: DataFrame, keys: list[str], order: list[str], value: str, threshold: float, gap: float, t: str) -> DataFrame:
    """Adds slip (jump over the threshold), gap (pause) and arc (count of both so far)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = series.withColumn("slip", F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)) > threshold, F.lit(False)))
    x = x.withColumn("gap", F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(False)))
    return x.withColumn("arc", F.sum((F.col("slip") | F.col("gap")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def geometry_free(l1: Column, l2: Column, wave1: float, wave2: float) -> Column:
    """Difference of two frequencies' phases in metres: free of positions and clocks, so it moves with the ionosphere and with slips."""
    return l1 * wave1 - l2 * wave2


def wide_lane(l1: Column, l2: Column, p1: Column, p2: Column, wave1: float, wave2: float) -> Column:
    """Wide-lane phase less narrow-lane range, in wide-lane cycles (Melbourne and Wuebbena): constant but for noise and slips."""
    share = (wave2 - wave1) / (wave2 + wave1)  # (f1 - f2) / (f1 + f2)
    return l1 - l2 - share * (p1 / wave1 + p2 / wave2)


def lost_lock(series: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Adds slip: the receiver's flag tells of lost lock (bit 0), or its half-cycle state (bit 1) differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce(F.col(flag).bitwiseXOR(F.lag(flag).over(w)).bitwiseAND(F.lit(2)) != 0, F.lit(False))
    return series.withColumn("slip", F.coalesce(F.col(flag).bitwiseAND(F.lit(1)) != 0, F.lit(False)) | changed)


def lock_counters(arcs: DataFrame, keys: list[str], order: list[str], minlock: int) -> DataFrame:
    """Adds lock: -minlock at a slip, one more with each later row of the arc; from 0 in the first arc."""
    w = Window.partitionBy(*keys, "arc").orderBy(*order)
    n = F.row_number().over(w) - 1
    return arcs.withColumn("lock", F.when(F.col("arc") > 0, n - minlock).otherwise(n).cast("long"))


def running_mean(arcs: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds n, mean and mean_var (variance of the mean) of each arc so far."""
    w = Window.partitionBy(*keys, "arc").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(value).over(w)
    var = F.greatest(F.avg(F.col(value) * F.col(value)).over(w) - F.pow(F.avg(value).over(w), 2), F.lit(0.0))
    return arcs.withColumn("n", n).withColumn("mean", F.avg(value).over(w)).withColumn("mean_var", var / n)


def inverse_diagonal(m: dict[tuple[int, int], Column]) -> list[Column]:
    """Diagonal of the inverse of a symmetric 4 x 4 matrix given by its upper triangle; null where it is singular."""
    at = lambda i, j: m[min(i, j), max(i, j)]

    def det3(r: list[int], c: list[int]) -> Column:
        a = lambda i, j: at(r[i], c[j])
        return a(0, 0) * (a(1, 1) * a(2, 2) - a(1, 2) * a(2, 1)) - a(0, 1) * (a(1, 0) * a(2, 2) - a(1, 2) * a(2, 0)) + a(0, 2) * (a(1, 0) * a(2, 1) - a(1, 1) * a(2, 0))

    rest = lambda k: [i for i in range(4) if i != k]
    det = sum((-1 if k % 2 else 1) * at(0, k) * det3(rest(0), rest(k)) for k in range(4))
    return [F.when(F.abs(det) > 1e-12, det3(rest(k), rest(k)) / det) for k in range(4)]


def dops(obs: DataFrame, keys: list[str], az: Column, el: Column, mask: float) -> DataFrame:
    """gdop, pdop, hdop, vdop of each group with four satellites over the mask at least. Angles in radians."""
    row = [F.cos(el) * F.sin(az), F.cos(el) * F.cos(az), F.sin(el), F.lit(1.0)]
    sums = [F.sum(row[i] * row[j]).alias(f"_m{i}{j}") for i in range(4) for j in range(i, 4)]
    g = obs.filter(el >= mask).groupBy(*keys).agg(F.count("*").alias("n"), *sums).filter("n >= 4")
    q = inverse_diagonal({(i, j): F.col(f"_m{i}{j}") for i in range(4) for j in range(i, 4)})
    root = lambda *k: F.sqrt(sum(q[i] for i in k))
    return g.select(*keys, "n", root(0, 1, 2, 3).alias("gdop"), root(0, 1, 2).alias("pdop"), root(0, 1).alias("hdop"), root(2).alias("vdop")).filter("gdop IS NOT NULL")
