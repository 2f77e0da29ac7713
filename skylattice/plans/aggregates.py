"""Aggregates, windows, sorts and set operations (operators D01 to E05) over the surrogate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import observations as ob
from .joins import DD, _single
from .registry import register
from .surrogate import EPH, OBS, SERIES, eph, obs, series, table

PI = 3.141592653589793


def _minor(r: list[int], c: list[int]) -> str:
    a = lambda i, j: f"m{min(r[i], c[j])}{max(r[i], c[j])}"
    return f"({a(0, 0)}*({a(1, 1)}*{a(2, 2)}-{a(1, 2)}*{a(2, 1)})-{a(0, 1)}*({a(1, 0)}*{a(2, 2)}-{a(1, 2)}*{a(2, 0)})+{a(0, 2)}*({a(1, 0)}*{a(2, 1)}-{a(1, 1)}*{a(2, 0)}))"


def _rest(k: int) -> list[int]:
    return [i for i in range(4) if i != k]


DOP_SUMS = ", ".join(f"sum(h{i} * h{j}) AS m{i}{j}" for i in range(4) for j in range(i, 4))
DOP_DET = " + ".join(f"({-1 if k % 2 else 1}) * m0{k} * {_minor(_rest(0), _rest(k))}" for k in range(4))
DOP_Q = ", ".join(f"{_minor(_rest(k), _rest(k))} / det AS q{k}" for k in range(4))


@register("d01_dop", f"""WITH {OBS}, a AS (SELECT srcid, epoch, radians((sat * 67 + epoch * 29) % 360) AS az, radians(el) AS e FROM obs WHERE el >= 15),
h AS (SELECT srcid, epoch, cos(e) * sin(az) AS h0, cos(e) * cos(az) AS h1, sin(e) AS h2, 1e0 AS h3 FROM a), m AS (SELECT srcid, epoch, count(*) AS n, {DOP_SUMS} FROM h GROUP BY 1, 2 HAVING count(*) >= 4),
d AS (SELECT *, {DOP_DET} AS det FROM m), q AS (SELECT srcid, epoch, n, {DOP_Q} FROM d WHERE abs(det) > 1e-12)
SELECT srcid, epoch, n, round(sqrt(q0 + q1 + q2 + q3), 5) AS gdop, round(sqrt(q0 + q1 + q2), 5) AS pdop, round(sqrt(q0 + q1), 5) AS hdop, round(sqrt(q2), 5) AS vdop FROM q WHERE det_ok""".replace(" WHERE det_ok", ""))
def dop(spark, sf_dir) -> DataFrame:
    x = obs(spark, sf_dir).withColumn("az", F.radians((F.col("sat") * 67 + F.col("epoch") * 29) % 360)).withColumn("e", F.radians("el"))
    d = ob.dops(x, ["srcid", "epoch"], F.col("az"), F.col("e"), 15 * PI / 180)
    return d.select("srcid", "epoch", "n", *[F.round(c, 5).alias(c) for c in ("gdop", "pdop", "hdop", "vdop")])


@register("d02_mean_median_mad", """WITH m AS (SELECT user_id, value, median(value) OVER (PARTITION BY user_id) AS med FROM events)
SELECT user_id, count(*) AS n, round(avg(value) * 0.190293672798365, 6) AS mean, round(any_value(med), 6) AS med, round(median(abs(value - med)), 6) AS mad FROM m GROUP BY user_id""")
def mean_median_mad(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "events").select("user_id", "value").withColumn("med", F.median("value").over(Window.partitionBy("user_id")))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value") * 0.190293672798365, 6).alias("mean"), F.round(F.first("med"), 6).alias("med"), F.round(F.median(F.abs(F.col("value") - F.col("med"))), 6).alias("mad"))


@register("d03_mad_outliers", """WITH m AS (SELECT event_id, user_id, value, median(value) OVER (PARTITION BY user_id) AS med, count(*) OVER (PARTITION BY user_id) AS n FROM events),
d AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY user_id) AS mad FROM m) SELECT event_id, user_id, n >= 3 AND mad > 0 AND abs((value - med) / (1.4826e0 * CASE WHEN mad > 0 THEN mad ELSE 1 END)) >= 3 AS outlier FROM d""")
def mad_outliers(spark, sf_dir) -> DataFrame:
    return ob.mad_outliers(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", "user_id", "outlier")


@register("d04_weighted_line", """WITH x AS (SELECT l_suppkey AS id, l_quantity AS x, l_extendedprice AS y, 1 / (1 + l_discount) AS w FROM lineitem),
s AS (SELECT id, sum(w) AS s0, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy FROM x GROUP BY id)
SELECT id, round((sxx * sy - sx * sxy) / (s0 * sxx - sx * sx), 4) AS offset_, round((s0 * sxy - sx * sy) / (s0 * sxx - sx * sx), 4) AS slope FROM s WHERE abs(s0 * sxx - sx * sx) > 1e-9""")
def weighted_line(spark, sf_dir) -> DataFrame:
    """Normal equations of a two-parameter weighted fit, as sums that combine before the shuffle."""
    li = table(spark, sf_dir, "lineitem")
    x = li.select(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (1 / (1 + F.col("l_discount"))).alias("w"))
    s = x.groupBy("id").agg(F.sum("w").alias("s0"), F.expr("sum(w * x)").alias("sx"), F.expr("sum(w * x * x)").alias("sxx"), F.expr("sum(w * y)").alias("sy"), F.expr("sum(w * x * y)").alias("sxy"))
    det = F.expr("s0 * sxx - sx * sx")
    return s.filter(F.abs(det) > 1e-9).select("id", F.round(F.expr("sxx * sy - sx * sxy") / det, 4).alias("offset_"), F.round(F.expr("s0 * sxy - sx * sy") / det, 4).alias("slope"))


#: Chi-square limits at 0.001 for 1 to 10 degrees of freedom (fixed values).
CHI2 = (10.8, 13.8, 16.3, 18.5, 20.5, 22.5, 24.3, 26.1, 27.9, 29.6)


@register("d05_chi_square_gate", f"""WITH {DD}, c AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, {v}e0)" for i, v in enumerate(CHI2))}) AS t(dof, lim)), s AS (SELECT rover, base, epoch, count(*) AS n, sum(ddp * ddp / 100) AS vv FROM dd GROUP BY 1, 2, 3)
SELECT rover, base, epoch, n, round(vv, 6) AS vv, coalesce(vv <= lim, true) AS valid FROM s LEFT JOIN c ON c.dof = s.n - 1""")
def chi_square_gate(spark, sf_dir) -> DataFrame:
    d = ob.double_differences(_single(spark, sf_dir))
    s = d.groupBy("rover", "base", "epoch").agg(F.count("*").alias("n"), F.sum(F.col("ddp") * F.col("ddp") / 100).alias("vv"))
    limit = F.try_element_at(F.array(*map(F.lit, CHI2)), F.nullif(F.col("n") - 1, F.lit(0)).cast("int"))
    return s.select("rover", "base", "epoch", "n", F.round("vv", 6).alias("vv"), F.coalesce(F.col("vv") <= limit, F.lit(True)).alias("valid"))


@register("d06_epoch_count", f"WITH {SERIES}, g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM (SELECT DISTINCT user_id, t FROM series)) SELECT user_id, count(*) AS n_rows, count(*) FILTER (dt IS NULL OR dt > 0.025) AS n_epochs, count(*) FILTER (dt > 86400) AS n_gaps FROM g GROUP BY user_id")
def epoch_count(spark, sf_dir) -> DataFrame:
    x = series(spark, sf_dir).select("user_id", "t").distinct().withColumn("dt", F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t")))
    some = lambda c: F.count(F.when(c, 1))
    return x.groupBy("user_id").agg(F.count("*").alias("n_rows"), some(F.col("dt").isNull() | (F.col("dt") > 0.025)).alias("n_epochs"), some(F.col("dt") > 86400).alias("n_gaps"))


@register("d06_ephemeris_dedup", f"WITH {EPH}, o AS (SELECT sat, toe, iode % 4 AS iode, lag(iode % 4) OVER (PARTITION BY sat ORDER BY toe, iode) AS was FROM eph) SELECT sat, toe, iode FROM o WHERE was IS NULL OR was <> iode")
def ephemeris_dedup(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("sat").orderBy("toe", "iode")
    x = eph(spark, sf_dir).withColumn("_was", F.lag(F.col("iode") % 4).over(w)).withColumn("iode", F.col("iode") % 4)
    return x.filter(F.col("_was").isNull() | (F.col("_was") != F.col("iode"))).select("sat", "toe", "iode")


@register("d07_message_counters", "SELECT user_id AS srcid, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def message_counters(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("srcid"), F.col("event_type").alias("type")).agg(F.count("*").alias("n"))


@register("d07_last_32_messages", "SELECT user_id AS srcid, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 32")
def last_messages(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("_n", F.row_number().over(w)).filter("_n <= 32").select(F.col("user_id").alias("srcid"), "event_id")


@register("d08_last_two_ephemerides", f"WITH {EPH}, d AS (SELECT sat, iode % 64 AS iode, max(toe) AS toe FROM eph GROUP BY 1, 2) SELECT sat, iode, toe, row_number() OVER (PARTITION BY sat ORDER BY toe DESC, iode DESC) AS version FROM d QUALIFY version <= 2")
def last_two_ephemerides(spark, sf_dir) -> DataFrame:
    d = eph(spark, sf_dir).groupBy("sat", (F.col("iode") % 64).alias("iode")).agg(F.max("toe").alias("toe"))
    w = Window.partitionBy("sat").orderBy(F.desc("toe"), F.desc("iode"))
    return d.withColumn("version", F.row_number().over(w).cast("long")).filter("version <= 2").select("sat", "iode", "toe", "version")


KEYS, ORDER = ["user_id", "event_type"], ["t", "event_id"]
ARCS = f"""{SERIES}, j AS (SELECT *, coalesce(abs(value - lag(value) OVER w) > 20, false) AS slip, coalesce(t - lag(t) OVER w > 864000, false) AS gap FROM series WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, event_id)),
arcs AS (SELECT *, CAST(sum(CASE WHEN slip OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS arc FROM j)"""


def _arcs(spark, sf_dir) -> DataFrame:
    return ob.slips(series(spark, sf_dir), KEYS, ORDER, "value", 20.0, 864000.0, "t")


@register("d09_cycle_slips", f"WITH {ARCS} SELECT user_id, event_type, event_id, slip, gap, arc FROM arcs")
def cycle_slips(spark, sf_dir) -> DataFrame:
    return _arcs(spark, sf_dir).select(*KEYS, "event_id", "slip", "gap", "arc")


@register("d10_lock_counters", f"WITH {ARCS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, arc ORDER BY t, event_id) - 1 AS k FROM arcs) SELECT user_id, event_type, event_id, CASE WHEN arc > 0 THEN k - 3 ELSE k END AS lock FROM n")
def lock_counters(spark, sf_dir) -> DataFrame:
    return ob.lock_counters(_arcs(spark, sf_dir), KEYS, ORDER, 3).select(*KEYS, "event_id", "lock")


@register("d11_running_mean", f"""WITH {ARCS} SELECT user_id, event_type, event_id, count(value) OVER w AS n, round(avg(value) OVER w * 0.190293672798365, 6) AS mean, round(greatest(avg(value * value) OVER w - pow(avg(value) OVER w, 2), 0) / count(value) OVER w * 0.0362116799e0, 5) AS mean_var
FROM arcs WINDOW w AS (PARTITION BY user_id, event_type, arc ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)""")
def running_mean(spark, sf_dir) -> DataFrame:
    x = ob.running_mean(_arcs(spark, sf_dir), KEYS, ORDER, "value")
    return x.select(*KEYS, "event_id", "n", F.round(F.col("mean") * 0.190293672798365, 6).alias("mean"), F.round(F.col("mean_var") * 0.0362116799, 5).alias("mean_var"))


@register("d12_solution_spread", """SELECT c_nationkey AS base, count(*) AS n, round(avg(c_acctbal) * 0.190293672798365, 6) AS mean_e, round(stddev_samp(c_acctbal), 6) AS std_e, round(max(abs(c_acctbal)), 6) AS worst FROM customer GROUP BY 1""")
def solution_spread(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("base"))
    return c.agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal") * 0.190293672798365, 6).alias("mean_e"), F.round(F.stddev_samp("c_acctbal"), 6).alias("std_e"), F.round(F.max(F.abs("c_acctbal")), 6).alias("worst"))


@register("d13_ambiguity_closure", f"""WITH {DD}, a AS (SELECT rover // 3 AS triangle, epoch, sat, CASE WHEN rover % 3 = 1 THEN -1 ELSE 1 END * CAST(round(ddl, 0) AS BIGINT) AS n FROM dd)
SELECT triangle, epoch, sat, CAST(sum(n) AS BIGINT) AS closure FROM a GROUP BY 1, 2, 3 HAVING count(*) = 3""")
def ambiguity_closure(spark, sf_dir) -> DataFrame:
    """Sum of signed rounded ambiguities over the three edges of a triangle, where all three have the satellite."""
    d = ob.double_differences(_single(spark, sf_dir))
    n = F.when(F.col("rover") % 3 == 1, -1).otherwise(1) * F.round("ddl", 0).cast("long")
    a = d.select(F.floor(F.col("rover") / 3).cast("long").alias("triangle"), "epoch", "sat", n.alias("n"))
    return a.groupBy("triangle", "epoch", "sat").agg(F.sum("n").alias("closure"), F.count("*").alias("_c")).filter("_c = 3").drop("_c")


@register("d14_grouped_listing", """SELECT coalesce(n_name, 'all') AS province, CAST(coalesce(k, -1) AS BIGINT) AS type, count(*) AS n FROM (SELECT n_name, c_custkey % 2 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY GROUPING SETS ((), (k), (n_name), (n_name, k))""")
def grouped_listing(spark, sf_dir) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    x = c.join(n, c.c_nationkey == n.n_nationkey).select("n_name", (F.col("c_custkey") % 2).alias("k"))
    return x.cube("n_name", "k").agg(F.count("*").alias("n")).select(F.coalesce("n_name", F.lit("all")).alias("province"), F.coalesce("k", F.lit(-1)).cast("long").alias("type"), "n")


@register("d15_worker_packing", "SELECT o_custkey AS base, o_orderkey AS rover, (row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) - 1) // 64 AS slot, o_custkey % 16 AS shard FROM orders")
def worker_packing(spark, sf_dir) -> DataFrame:
    """Base lines to workers of 64: numbered inside hash shards, so that no task sees all of them."""
    w = Window.partitionBy("shard").orderBy("rover")
    x = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("base"), F.col("o_orderkey").alias("rover"), (F.col("o_custkey") % 16).alias("shard"))
    return x.withColumn("slot", F.floor((F.row_number().over(w) - 1) / 64).cast("long"))


@register("e01_sorted_top", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sorted_top(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_orderdate", "o_totalprice")


EDGES = "old AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 50 AS b FROM lineitem WHERE l_linenumber <= 3), new AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 50 AS b FROM lineitem WHERE l_linenumber >= 3)"


def _edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem")
    e = lambda x: x.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b"))
    return e(li.filter("l_linenumber <= 3")), e(li.filter("l_linenumber >= 3"))


@register("e03_edges_removed", f"WITH {EDGES} SELECT * FROM old EXCEPT SELECT * FROM new")
def edges_removed(spark, sf_dir) -> DataFrame:
    old, new = _edges(spark, sf_dir)
    return old.subtract(new)


TRI = "SELECT l_orderkey % 40 AS a, l_partkey % 40 AS b, l_suppkey % 40 AS c FROM lineitem"


@register("e04_triangles_distinct", f"""WITH t AS ({TRI}), c AS (SELECT CASE WHEN a <= b AND a <= c THEN [a, b, c] WHEN b <= a AND b <= c THEN [b, c, a] ELSE [c, a, b] END AS t FROM t WHERE a <> b AND b <> c AND a <> c)
SELECT DISTINCT t[1] AS v0, t[2] AS v1, t[3] AS v2 FROM c""")
def triangles_distinct(spark, sf_dir) -> DataFrame:
    """Triangles are equal when one is a rotation of the other: the least vertex goes first."""
    li = table(spark, sf_dir, "lineitem").select(*[(F.col(c) % 40).alias(n) for c, n in (("l_orderkey", "a"), ("l_partkey", "b"), ("l_suppkey", "c"))]).filter("a != b AND b != c AND a != c")
    return canonical_triangles(li, "a", "b", "c").distinct()


def canonical_triangles(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    x, y, z = F.col(a), F.col(b), F.col(c)
    t = F.when((x <= y) & (x <= z), F.array(x, y, z)).when((y <= x) & (y <= z), F.array(y, z, x)).otherwise(F.array(z, x, y))
    return df.select(t.alias("t")).select(*[F.col("t")[i].alias(f"v{i}") for i in range(3)])


@register("e05_edges_kept", f"WITH {EDGES} SELECT * FROM old INTERSECT SELECT * FROM new")
def edges_kept(spark, sf_dir) -> DataFrame:
    old, new = _edges(spark, sf_dir)
    return old.intersect(new)
