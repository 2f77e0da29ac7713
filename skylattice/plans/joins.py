"""Filters, joins and differences (operators C01 to C21) over the surrogate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import observations as ob
from ..operators import spatial, timejoin
from ..operators.staging import staged
from .registry import register
from .surrogate import EPH, OBS, STA, VSTA, eph, obs, req, sta, table, vsta

MASK = [20.0, 22.0, 24.0, 27.0, 30.0, 33.0, 35.0, 38.0, 40.0]


@register("c01_satellite_exclusion", f"""WITH {OBS}, h AS (SELECT srcid, epoch, sat, (sat * 5 + epoch) % 7 - 1 AS svh, CASE WHEN sat = 3 THEN 1 WHEN sat = 5 THEN 2 ELSE 0 END AS listed, p * 40000 AS var FROM obs)
SELECT srcid, epoch, sat FROM h WHERE NOT (svh < 0 OR (listed <> 2 AND (listed = 1 OR (CASE WHEN sat % 4 = 0 THEN (svh & 254) <> 0 ELSE svh <> 0 END) OR var > 90000)))""")
def satellite_exclusion(spark, sf_dir) -> DataFrame:
    health = ((F.col("sat") * 5 + F.col("epoch")) % 7 - 1).cast("long")
    listed = F.when(F.col("sat") == 3, 1).when(F.col("sat") == 5, 2).otherwise(0)
    return obs(spark, sf_dir).filter(~ob.excluded(health, listed, F.col("p") * 40000, F.col("sat") % 4 == 0)).select("srcid", "epoch", "sat")


@register("c02_snr_mask", f"""WITH {OBS}, m AS (SELECT *, (el + 5.0e0) / 10.0e0 AS a0, [20.0e0, 22, 24, 27, 30, 33, 35, 38, 40] AS mk FROM obs), n AS (SELECT *, CAST(floor(a0) AS INT) AS i, a0 - floor(a0) AS a FROM m)
SELECT srcid, epoch, sat, el, snr FROM n WHERE snr >= CASE WHEN i < 1 THEN mk[1] WHEN i > 8 THEN mk[9] ELSE (1 - a) * mk[i] + a * mk[i + 1] END""")
def snr_screen(spark, sf_dir) -> DataFrame:
    return obs(spark, sf_dir).filter(F.col("snr") >= ob.snr_mask(F.col("el"), MASK)).select("srcid", "epoch", "sat", "el", "snr")


@register("c03_elevation_and_missing", f"WITH {OBS} SELECT srcid, epoch, sat, nullif(round(p, 0), 0) AS p FROM obs WHERE el >= 15 AND nullif(round(p, 0), 0) IS NOT NULL")
def elevation_and_missing(spark, sf_dir) -> DataFrame:
    x = obs(spark, sf_dir).withColumn("p", F.nullif(F.round("p", 0), F.lit(0.0)))
    return x.filter((F.col("el") >= 15) & F.col("p").isNotNull()).select("srcid", "epoch", "sat", "p")


@register("c04_time_screen", f"WITH {OBS}, r AS (SELECT min(epoch) AS lo FROM obs) SELECT srcid, epoch, sat FROM obs, r WHERE epoch >= lo + 5 AND epoch < lo + 25 AND (epoch - lo) % 3 = 0")
def time_screen(spark, sf_dir) -> DataFrame:
    x = obs(spark, sf_dir)
    lo = x.agg(F.min("epoch")).head()[0]
    return x.filter((F.col("epoch") >= lo + 5) & (F.col("epoch") < lo + 25) & (F.pmod(F.col("epoch") - lo, F.lit(3)) == 0)).select("srcid", "epoch", "sat")


@register("c05_key_lookup", "SELECT event_id, c_custkey AS id, c_name AS name FROM events JOIN customer ON user_id = c_custkey")
def key_lookup(spark, sf_dir) -> DataFrame:
    e, c = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    return e.join(c, e.user_id == c.c_custkey).select("event_id", F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def baselines(x: DataFrame) -> DataFrame:
    return x.select(F.col("srcid").alias("rover"), (F.col("srcid") - 1).alias("base")).filter("rover > 0").distinct()


def _single(spark, sf_dir) -> DataFrame:
    x = obs(spark, sf_dir)
    return ob.single_differences(x, baselines(x), 15.0)


SD = f"""{OBS}, sd AS (SELECT r.srcid AS rover, b.srcid AS base, r.epoch, r.sat, r.grp, r.el, CASE WHEN r.p = 0 OR b.p = 0 THEN 0 ELSE r.p - b.p END AS sdp, CASE WHEN r.l = 0 OR b.l = 0 THEN 0 ELSE r.l - b.l END AS sdl
FROM obs r JOIN obs b ON b.srcid = r.srcid - 1 AND b.epoch = r.epoch AND b.sat = r.sat WHERE b.el >= 15)"""
DD = f"""{SD}, ref AS (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY rover, base, epoch, grp ORDER BY el DESC, sat DESC) = 1),
dd AS (SELECT s.rover, s.base, s.epoch, s.grp, s.sat, f.sat AS ref, s.sdp - f.sdp AS ddp, s.sdl - f.sdl AS ddl, (f.sat << 16) | (s.sat << 8) AS vflg FROM sd s JOIN ref f USING (rover, base, epoch, grp) WHERE s.sat <> f.sat)"""


@register("c06_common_satellites", f"WITH {SD} SELECT rover, base, epoch, sat FROM sd")
def common_satellites(spark, sf_dir) -> DataFrame:
    return _single(spark, sf_dir).select("rover", "base", "epoch", "sat")


@register("c07_epoch_tolerance", """WITH s AS (SELECT event_id, user_id % 8 AS src, epoch_us(ts) / 1e6 AS t FROM events)
SELECT r.event_id AS rover_event, b.event_id AS base_event, round(r.t - b.t, 6) AS dt FROM s r JOIN s b ON b.src = r.src - 1 AND abs(r.t - b.t) <= 60""")
def epoch_tolerance(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("src"), (F.expr("unix_micros(cast(ts as timestamp))") / 1e6).alias("t"))
    r = s.select((F.col("src") - 1).alias("src"), F.col("event_id").alias("rover_event"), F.col("t").alias("_tr"))
    b = s.select("src", F.col("event_id").alias("base_event"), F.col("t").alias("_tb"))
    return timejoin.within(r, b, ["src"], "_tr", "_tb", 60.0).select("rover_event", "base_event", F.round(F.col("_tr") - F.col("_tb"), 6).alias("dt"))


@register("c08_all_edges_synced", f"""WITH {SD}, ed AS (SELECT DISTINCT rover, base, epoch FROM sd), d AS (SELECT rover AS v, count(DISTINCT base) AS deg FROM ed GROUP BY 1 UNION ALL SELECT base, count(DISTINCT rover) FROM ed GROUP BY 1),
deg AS (SELECT v, CAST(sum(deg) AS BIGINT) AS deg FROM d GROUP BY v), u AS (SELECT rover AS v, epoch, base AS o FROM ed UNION ALL SELECT base, epoch, rover FROM ed)
SELECT u.v AS vertex, u.epoch, count(*) AS n_edges FROM u JOIN deg ON u.v = deg.v GROUP BY u.v, u.epoch, deg.deg HAVING count(*) = deg.deg""")
def all_edges_synced(spark, sf_dir) -> DataFrame:
    e = _single(spark, sf_dir).select("rover", "base", "epoch").distinct()
    u = e.select(F.col("rover").alias("vertex"), "epoch", F.col("base").alias("o")).unionAll(e.select("base", "epoch", "rover"))
    deg = u.groupBy("vertex").agg(F.countDistinct("o").alias("deg"))
    n = u.groupBy("vertex", "epoch").agg(F.count("*").alias("n_edges"))
    return n.join(deg, "vertex").filter("n_edges = deg").select("vertex", "epoch", "n_edges")


def _vs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = vsta(spark, sf_dir).select(F.col("id").alias("vid"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"))
    return v, sta(spark, sf_dir).select("id", "x", "y", "z")


D2 = "(v.x - s.x) * (v.x - s.x) + (v.y - s.y) * (v.y - s.y) + (v.z - s.z) * (v.z - s.z)"


@register("c09_nearest_station", f"""WITH {STA}, {VSTA}, d AS (SELECT v.id AS vid, s.id, {D2} AS d2 FROM vsta v, sta s)
SELECT vid, id, round(sqrt(d2), 4) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vid ORDER BY d2, id) = 1""")
def nearest_station(spark, sf_dir) -> DataFrame:
    v, s = _vs(spark, sf_dir)
    return spatial.nearest(v, s, "vid", "id", ("vx", "vy", "vz"), ("x", "y", "z"), 1, 40_000.0, 2_000_000.0).select("vid", "id", F.round(F.sqrt("d2"), 4).alias("distance"))


@register("c10_radius_join", f"WITH {STA} SELECT v.id AS vid, s.id, round(sqrt({D2}), 4) AS distance FROM sta v, sta s WHERE {D2} <= 9e8 AND v.id <> s.id")
def radius_join(spark, sf_dir) -> DataFrame:
    s = sta(spark, sf_dir)
    v = s.select(F.col("id").alias("vid"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"))
    got = spatial.radius_pairs(v, s.select("id", "x", "y", "z"), ("vx", "vy", "vz"), ("x", "y", "z"), 30_000.0)
    return got.filter("vid != id").select("vid", "id", F.round(F.sqrt("d2"), 4).alias("distance"))


@register("c11_k_nearest", f"""WITH {STA}, {VSTA}, d AS (SELECT v.id AS vid, s.id, {D2} AS d2 FROM vsta v, sta s)
SELECT vid, id, CAST(row_number() OVER (PARTITION BY vid ORDER BY d2, id) AS INT) AS rank, round(sqrt(d2), 4) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vid ORDER BY d2, id) <= 4""")
def k_nearest(spark, sf_dir) -> DataFrame:
    v, s = _vs(spark, sf_dir)
    return spatial.nearest(v, s, "vid", "id", ("vx", "vy", "vz"), ("x", "y", "z"), 4, 80_000.0, 2_000_000.0).select("vid", "id", "rank", F.round(F.sqrt("d2"), 4).alias("distance"))


def rings(spark, sf_dir) -> DataFrame:
    """A rectangle of 0.8 degrees for each region, with a notch, so that it isn't convex."""
    k = F.col("r_regionkey")
    at = lambda dx, y: F.struct((105e0 + 0.8 * (k + dx)).alias("x"), F.lit(y).alias("y"))
    ring = F.array(at(0.0, 29.0), at(1.0, 29.0), at(1.0, 32.0), at(0.5, 30.0), at(0.0, 32.0))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("province"), ring.alias("ring"))


RINGS = """k AS (SELECT r_regionkey AS province, unnest([[0, 29e0, 1, 29e0], [1, 29e0, 1, 32e0], [1, 32e0, 0.5e0, 30e0], [0.5e0, 30e0, 0, 32e0], [0, 32e0, 0, 29e0]]) AS e FROM region),
edges AS (SELECT province, 105e0 + 0.8e0 * (province + e[1]) AS ax, e[2] AS ay, 105e0 + 0.8e0 * (province + e[3]) AS bx, e[4] AS by_ FROM k)"""


@register("c12_point_in_polygon", f"""WITH {STA}, {RINGS}, c AS (SELECT id, lon, lat, province, count(*) AS n FROM sta, edges WHERE (ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax GROUP BY 1, 2, 3, 4)
SELECT id, lon, lat, min(province) AS province FROM c WHERE n % 2 = 1 GROUP BY 1, 2, 3""")
def point_in_polygon(spark, sf_dir) -> DataFrame:
    return spatial.in_polygons(sta(spark, sf_dir).select("id", "lon", "lat"), rings(spark, sf_dir), "lon", "lat", "province")


@register("c13_containing_triangle", f"""WITH {VSTA}, tri AS (SELECT r_regionkey AS tri, 105e0 + 0.8e0 * r_regionkey AS x0 FROM region),
e AS (SELECT tri, x0, unnest([[0, 29e0, 1.6e0, 29e0], [1.6e0, 29e0, 0.8e0, 32e0], [0.8e0, 32e0, 0, 29e0]]) AS e FROM tri),
c AS (SELECT id, tri, count(*) FILTER ((e[2] > lat) <> (e[4] > lat) AND lon < (e[3] - e[1]) * (lat - e[2]) / (e[4] - e[2]) + x0 + e[1]) AS n, min((lon - x0 - 0.8e0) * (lon - x0 - 0.8e0) + (lat - 30e0) * (lat - 30e0)) AS d2 FROM vsta, e GROUP BY 1, 2)
SELECT id, tri, n % 2 = 1 AS inside FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n % 2 DESC, CASE WHEN n % 2 = 1 THEN 0 ELSE d2 END, tri) = 1""")
def containing_triangle(spark, sf_dir) -> DataFrame:
    """The first triangle that holds each virtual station, else the one with the nearest centre."""
    v = vsta(spark, sf_dir).select("id", "lon", "lat")
    x0 = 105e0 + 0.8 * F.col("r_regionkey")
    at = lambda dx, y: F.struct((x0 + dx).alias("x"), F.lit(y).alias("y"))
    t = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("tri"), F.array(at(0.0, 29.0), at(1.6, 29.0), at(0.8, 32.0)).alias("ring"), (x0 + 0.8).alias("cx"))
    cells = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    held = staged(spatial.in_polygons(v, t.select("tri", "ring"), "lon", "lat", "tri").select("id", "tri", F.lit(True).alias("inside")))
    rest = staged(v.join(held, "id", "left_anti"))
    by = {}
    width = 4.0
    while True:  # centres within a growing distance of the longitude
        c = t.select("tri", "cx", (F.floor(F.col("cx") / width).cast("long")).alias("_c")).withColumn("_s", cells).withColumn("_c", F.col("_c") + F.col("_s")).drop("_s")
        near = rest.withColumn("_c", F.floor(F.col("lon") / width).cast("long")).join(c, "_c")
        d2 = (F.col("lon") - F.col("cx")) * (F.col("lon") - F.col("cx")) + (F.col("lat") - 30.0) * (F.col("lat") - 30.0)
        got = near.withColumn("d2", d2).filter(F.col("d2") <= width * width).groupBy("id").agg(F.min_by("tri", F.struct("d2", "tri")).alias("tri"), F.lit(False).alias("inside"))
        by[width] = got = staged(got)
        if width >= 360 or rest.join(got, "id", "left_anti").limit(1).count() == 0:
            break
        width *= 2
    return held.unionByName(by[width])


@register("c14_master_station", f"""WITH {STA}, {VSTA}, c AS (SELECT max(s_suppkey) AS last FROM supplier), t AS (SELECT v.*, unnest([1, 7, 19]) AS step FROM vsta v),
n AS (SELECT v.id AS vid, s.id, {D2} AS d2 FROM t v, c JOIN sta s ON s.id = v.id * v.step % last + 1)
SELECT vid, id AS master, round(sqrt(d2), 4) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY vid ORDER BY d2, id) = 1""")
def master_station(spark, sf_dir) -> DataFrame:
    """The nearest of the three stations of each virtual station's triangle; three rows are joined for each."""
    v, s = _vs(spark, sf_dir)
    last = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).head()[0] or 0
    d2 = (F.col("vx") - F.col("x")) * (F.col("vx") - F.col("x")) + (F.col("vy") - F.col("y")) * (F.col("vy") - F.col("y")) + (F.col("vz") - F.col("z")) * (F.col("vz") - F.col("z"))
    corner = F.explode(F.array(*[(F.col("vid") * k % max(last, 1) + 1).cast("long") for k in (1, 7, 19)]))
    j = v.withColumn("_corner", corner).join(s, F.col("_corner") == F.col("id")).withColumn("d2", d2)
    best = j.groupBy("vid").agg(F.min(F.struct("d2", "id")).alias("_b"))
    return best.select("vid", F.col("_b.id").alias("master"), F.round(F.sqrt("_b.d2"), 4).alias("distance"))


@register("c15_adjacent_azimuth", """WITH c AS (SELECT o_custkey AS id, (o_orderkey * 37 % 3600) / 10e0 AS az, (o_custkey * 113 % 3600) / 10e0 AS bearing, o_orderkey FROM orders),
g AS (SELECT id, o_orderkey, az - bearing - 360e0 * floor((az - bearing) / 360e0) AS cw FROM c)
SELECT id, min_by(o_orderkey, {'a': round(cw, 6), 'b': o_orderkey}) AS clockwise, min_by(o_orderkey, {'a': round(CASE WHEN cw = 0 THEN 0e0 ELSE 360e0 - cw END, 6), 'b': o_orderkey}) AS counter FROM g GROUP BY id""")
def adjacent_azimuth(spark, sf_dir) -> DataFrame:
    """Of each station's base lines, those with the least clockwise and counter-clockwise turn from a bearing."""
    az, bearing = (F.col("o_orderkey") * 37 % 3600) / 10e0, (F.col("o_custkey") * 113 % 3600) / 10e0
    cw = az - bearing - 360e0 * F.floor((az - bearing) / 360e0)
    g = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", cw.alias("cw"))
    key = lambda x: F.struct(F.round(x, 6), F.col("o_orderkey"))
    ccw = F.when(F.col("cw") == 0, F.lit(0e0)).otherwise(360e0 - F.col("cw"))
    return g.groupBy("id").agg(F.min_by("o_orderkey", key(F.col("cw"))).alias("clockwise"), F.min_by("o_orderkey", key(ccw)).alias("counter"))


WEEK = 604800


@register("c16_asof_ephemeris", f"""WITH {EPH} SELECT r.sat, r.t, e.toe, e.iode FROM req r JOIN eph e ON e.sat = r.sat AND abs(e.toe - r.t) <= {WEEK}
QUALIFY row_number() OVER (PARTITION BY r.sat, r.t ORDER BY abs(e.toe - r.t), e.iode DESC) = 1""")
def asof_ephemeris(spark, sf_dir) -> DataFrame:
    return timejoin.nearest(req(spark, sf_dir), eph(spark, sf_dir), ["sat"], "t", "toe", WEEK, [F.col("iode")]).select("sat", "t", "toe", "iode")


@register("c16_asof_ephemeris_before", f"""WITH {EPH} SELECT r.sat, r.t, e.toe, e.iode FROM req r JOIN eph e ON e.sat = r.sat AND e.toe < r.t AND r.t - e.toe <= {WEEK}
QUALIFY row_number() OVER (PARTITION BY r.sat, r.t ORDER BY r.t - e.toe, e.iode DESC) = 1""")
def asof_ephemeris_before(spark, sf_dir) -> DataFrame:
    """Galileo's rule: the reference time must lie before the request."""
    return timejoin.nearest(req(spark, sf_dir), eph(spark, sf_dir), ["sat"], "t", "toe", WEEK, [F.col("iode")], before_only=True).select("sat", "t", "toe", "iode")


@register("c17_bracket_interpolation", f"""WITH {EPH}, m AS (SELECT sat, toe, avg(iode) AS v FROM eph GROUP BY 1, 2), b AS (SELECT *, lead(toe) OVER w AS next_t, lead(v) OVER w AS nv FROM m WINDOW w AS (PARTITION BY sat ORDER BY toe))
SELECT r.sat, r.t, round(v + (r.t - toe) / (next_t - toe) * (nv - v), 4) AS v FROM req r JOIN b ON b.sat = r.sat AND r.t >= toe AND r.t < next_t AND next_t - toe <= {WEEK}""")
def bracket_interpolation(spark, sf_dir) -> DataFrame:
    m = eph(spark, sf_dir).groupBy("sat", "toe").agg(F.avg("iode").alias("v"))
    return timejoin.interpolated(req(spark, sf_dir), m, ["sat"], "t", "toe", ["v"], WEEK).select("sat", "t", F.round("v", 4).alias("v"))


@register("c18_validity_interval", f"""WITH {EPH}, pcv AS (SELECT sat, toe AS ts, toe + 2592000 AS te, iode AS ord FROM eph)
SELECT r.sat, r.t, p.ts, p.te, p.ord FROM req r JOIN pcv p ON p.sat = r.sat AND r.t >= p.ts AND r.t <= p.te QUALIFY row_number() OVER (PARTITION BY r.sat, r.t ORDER BY p.ord) = 1""")
def validity_interval(spark, sf_dir) -> DataFrame:
    pcv = eph(spark, sf_dir).select("sat", F.col("toe").alias("ts"), (F.col("toe") + 2592000).alias("te"), F.col("iode").alias("ord"))
    return timejoin.valid_at(req(spark, sf_dir), pcv, ["sat"], "t", "ts", "te", "ord", 2592000)


@register("c18_receiver_antenna", """WITH t AS (SELECT p_partkey, p_name, p_type FROM part), k AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS a, split_part(p_type, ' ', 1) AS r FROM part)
SELECT k.p_brand, k.a, k.r, t.p_partkey AS antenna FROM k JOIN t ON split_part(t.p_name, ' ', 1) = k.a QUALIFY row_number() OVER (PARTITION BY k.p_brand, k.a, k.r ORDER BY CASE WHEN contains(t.p_type, k.r) THEN 0 ELSE 1 END, t.p_partkey) = 1""")
def receiver_antenna(spark, sf_dir) -> DataFrame:
    """Type and radome match before a match of the type alone, then file order."""
    p = table(spark, sf_dir, "part")
    word = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(1))
    k = p.select("p_brand", word("p_name").alias("a"), word("p_type").alias("r")).distinct()
    t = p.groupBy(word("p_name").alias("a"), "p_type").agg(F.min("p_partkey").alias("p_partkey"))  # of equal ones only the first in the file can be the answer
    rank = F.struct(F.when(F.contains("p_type", "r"), 0).otherwise(1), F.col("p_partkey"))
    return k.join(t, "a").groupBy("p_brand", "a", "r").agg(F.min_by("p_partkey", rank).alias("antenna"))


@register("c19_source_exists", "SELECT s_suppkey AS id, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) AS active FROM supplier")
def source_exists(spark, sf_dir) -> DataFrame:
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    yes, no = s.join(li, "s_suppkey", "left_semi"), s.join(li, "s_suppkey", "left_anti")
    return yes.select(F.col("s_suppkey").alias("id"), F.lit(True).alias("active")).unionAll(no.select("s_suppkey", F.lit(False)))


@register("c20_single_difference", f"WITH {SD} SELECT rover, base, epoch, sat, round(sdp, 6) AS sdp, round(sdl, 6) AS sdl FROM sd")
def single_difference(spark, sf_dir) -> DataFrame:
    return _single(spark, sf_dir).select("rover", "base", "epoch", "sat", F.round("sdp", 6).alias("sdp"), F.round("sdl", 6).alias("sdl"))


@register("c21_double_difference", f"WITH {DD} SELECT rover, base, epoch, grp, sat, ref, round(ddp, 6) AS ddp, round(ddl, 6) AS ddl, vflg FROM dd")
def double_difference(spark, sf_dir) -> DataFrame:
    d = ob.double_differences(_single(spark, sf_dir))
    return d.select("rover", "base", "epoch", "grp", "sat", "ref", F.round("ddp", 6).alias("ddp"), F.round("ddl", 6).alias("ddl"), "vflg")


@register("double_difference_outliers", f"""WITH {DD}, m AS (SELECT *, median(ddp) OVER w AS med, count(*) OVER w AS n FROM dd WINDOW w AS (PARTITION BY rover, base, epoch)),
d AS (SELECT *, median(abs(ddp - med)) OVER (PARTITION BY rover, base, epoch) AS mad FROM m)
SELECT rover, base, epoch, sat, ref, round(ddp, 6) AS ddp, n >= 3 AND mad > 0 AND abs((ddp - med) / (1.4826e0 * CASE WHEN mad > 0 THEN mad ELSE 1 END)) >= 3 AS outlier FROM d""")
def double_difference_outliers(spark, sf_dir) -> DataFrame:
    """Screen, pair, difference and flag: the flagship query."""
    d = ob.mad_outliers(ob.double_differences(_single(spark, sf_dir)), ["rover", "base", "epoch"], "ddp")
    return d.select("rover", "base", "epoch", "sat", "ref", F.round("ddp", 6).alias("ddp"), "outlier")
