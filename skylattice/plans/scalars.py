"""Scalar functions (operators G01 to G25) over the surrogate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import atmosphere as at
from ..functions import bits, codes, geodesy, nmea, timescale
from .registry import register
from .surrogate import OBS, STA, VSTA, obs, sta, table, vsta

SYS = ((s, a, n) for s, a, n, _ in codes.SYSTEMS)
NAME = "CASE " + " ".join(f"WHEN s BETWEEN {a} AND {a + n - 1} THEN '{k}' || lpad(CAST(s - {a - 1} AS VARCHAR), 2, '0')" for k, a, n in SYS) + " END"


@register("g01_satellite_codes", f"WITH n AS (SELECT p_partkey, p_partkey % 170 AS s FROM part) SELECT p_partkey, {NAME} AS name, CASE WHEN {NAME} IS NULL THEN NULL ELSE s END AS back FROM n")
def satellite_codes(spark, sf_dir) -> DataFrame:
    name = codes.sat_name(F.col("p_partkey") % 170)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("back", codes.sat_number(F.col("name")))


FREQ = "CASE " + " ".join(f"WHEN sys = '{k}' AND band = '{d}' THEN {m * 1e6!r}" + (f" + ch * {codes.GLONASS_STEP[d] * 1e6!r}" if k == "R" and d in codes.GLONASS_STEP else "") for k, bands in codes.BANDS.items() for d, m in bands.items()) + " END"


@register("g03_signal_frequency", f"WITH c AS (SELECT p_partkey, substr('GREJC', CAST(p_partkey % 5 + 1 AS INT), 1) AS sys, CAST(p_partkey % 8 + 1 AS VARCHAR) AS band, p_partkey % 14 - 7 AS ch FROM part) SELECT p_partkey, sys, band || 'C' AS code, {FREQ} AS hz FROM c")
def signal_frequency(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select("p_partkey", F.substring(F.lit("GREJC"), k.cast("int") % 5 + 1, F.lit(1)).alias("sys"), F.concat((k % 8 + 1).cast("string"), F.lit("C")).alias("code"), (k % 14 - 7).alias("ch"))
    return c.select("p_partkey", "sys", "code", codes.frequency(F.col("sys"), F.col("code"), F.col("ch")).alias("hz"))


@register("g02_code_priority", "WITH c AS (SELECT p_partkey, p_brand, substr('abcdefghijklmnopqrstuvwxyz', CAST(p_size % 26 AS INT) + 1, 1) AS code FROM part) SELECT p_brand, min(instr('zyxwvutsrqponmlkjihgfedcba', code)) AS best, arg_min(code, instr('zyxwvutsrqponmlkjihgfedcba', code)) AS code FROM c GROUP BY p_brand")
def code_priority(spark, sf_dir) -> DataFrame:
    """The signal of each band that stands first in a priority string."""
    code = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.col("p_size").cast("int") % 26 + 1, F.lit(1))
    x = table(spark, sf_dir, "part").select("p_brand", code.alias("code"), F.instr(F.lit("zyxwvutsrqponmlkjihgfedcba"), code).cast("long").alias("at"))
    return x.groupBy("p_brand").agg(F.min("at").alias("best"), F.min_by("code", "at").alias("code"))


@register("g04_bit_fields", """WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), v AS (SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS z, CAST('0x' || right(h, 8) AS BIGINT) AS w FROM b WHERE length(h) >= 8)
SELECT doc_id, (z >> 20) & 4095 AS u12, CASE WHEN (w >> 10) & 1023 >= 512 THEN ((w >> 10) & 1023) - 1024 ELSE (w >> 10) & 1023 END AS s10, CASE WHEN (w >> 9) & 1 = 1 THEN -(w & 511) ELSE w & 511 END AS m10 FROM v""")
def bit_fields(spark, sf_dir) -> DataFrame:
    """Fields of each text's first and last four bytes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("b")).filter(F.octet_length("b") >= 4)
    b, last = F.col("b"), F.substring("b", -4, 4)
    return d.select("doc_id", bits.unsigned(b, 0, 12).alias("u12"), bits.signed(last, 12, 10).alias("s10"), bits.sign_magnitude(last, 22, 10).alias("m10"))


CRC24_SQL = "list_reduce(list_concat([CAST(0 AS BIGINT)], bytes), lambda crc, b: list_reduce(list_concat([xor(crc, b << 16)], CAST(range(8) AS BIGINT[])), lambda v, i: CASE WHEN (v << 1) & 16777216 <> 0 THEN xor(v << 1, 25578747) ELSE v << 1 END))"
CRC32_SQL = "list_reduce(list_concat([CAST(0 AS BIGINT)], bytes), lambda crc, b: list_reduce(list_concat([xor(crc, b)], CAST(range(8) AS BIGINT[])), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"
XOR_SQL = "list_reduce(list_concat([CAST(0 AS BIGINT)], bytes), lambda crc, b: xor(crc, b))"


@register("g05_checksums", f"""WITH h AS (SELECT event_id, hex(encode(props)) AS h FROM events), o AS (SELECT event_id, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, CAST(i AS BIGINT), 2) AS BIGINT)) AS bytes FROM h)
SELECT event_id, {CRC24_SQL} AS crc24q, {CRC32_SQL} AS crc32, right(printf('%02X', {XOR_SQL}), 2) AS xor FROM o""")
def checksums(spark, sf_dir) -> DataFrame:
    b = F.encode("props", "utf-8")
    return table(spark, sf_dir, "events").select("event_id", bits.crc24q(b).alias("crc24q"), bits.crc32_plain(b).alias("crc32"), bits.xor_checksum(F.col("props")).alias("xor"))


@register("g06_base64", "SELECT page_id, to_base64(encode(url)) AS b64, decode(from_base64(to_base64(encode(url)))) AS back FROM pages")
def base64(spark, sf_dir) -> DataFrame:
    b = F.regexp_replace(F.base64(F.encode("url", "utf-8")), "\\s", "")  # in one line, however long
    return table(spark, sf_dir, "pages").select("page_id", b.alias("b64"), F.decode(F.unbase64(b), "utf-8").alias("back"))


T = "epoch_us(o_orderdate) // 1000000 + o_orderkey % 86400"


def _t() -> F.Column:
    return F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000 + o_orderkey % 86400")


@register("g07_calendar", f"WITH t AS (SELECT o_orderkey, make_timestamp(({T}) * 1000000) AS ts FROM orders) SELECT o_orderkey, CAST(year(ts) AS BIGINT) AS y, CAST(dayofyear(ts) AS BIGINT) AS doy, strftime(ts, '%Y/%m/%d %H:%M:%S') AS text, CAST(year(ts) % 100 AS BIGINT) AS yy, CAST(CASE WHEN year(ts) % 100 < 80 THEN 2000 ELSE 1900 END + year(ts) % 100 AS BIGINT) AS full_year FROM t")
def calendar(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.timestamp_seconds(_t()).alias("ts"))
    yy = F.year("ts").cast("long") % 100
    return x.select("o_orderkey", F.year("ts").cast("long").alias("y"), F.dayofyear("ts").cast("long").alias("doy"), F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("text"), yy.alias("yy"), (F.when(yy < 80, 2000).otherwise(1900) + yy).cast("long").alias("full_year"))


LEAP = lambda t, k: "CASE " + " ".join(f"WHEN {t} >= {s + k * n} THEN {n}" for s, n in timescale.LEAPS) + " ELSE 0 END"


@register("g08_time_scales", f"""WITH t AS (SELECT o_orderkey, {T} AS t FROM orders)
SELECT o_orderkey, CAST(floor((t - 315964800) / 604800.0) AS BIGINT) AS week, (t - 315964800) % 604800 AS tow, t + {LEAP("t", 0)} AS gps, t - {LEAP("t", 1)} AS utc, t - 14 AS bdt, CAST(floor((t - 935280000) / 604800.0) AS BIGINT) AS gst_week, o_orderkey % 1024 + CAST(floor((2300 - o_orderkey % 1024 + 512) / 1024.0) AS BIGINT) * 1024 AS rolled FROM t""")
def time_scales(spark, sf_dir) -> DataFrame:
    t = F.col("t")
    x = table(spark, sf_dir, "orders").select("o_orderkey", _t().alias("t"))
    week, tow = timescale.week_of(t)
    return x.select("o_orderkey", week.alias("week"), tow.alias("tow"), timescale.utc_to_gps(t).alias("gps"), timescale.gps_to_utc(t).alias("utc"), timescale.gps_to_bdt(t).alias("bdt"), timescale.week_of(t, timescale.GST0)[0].alias("gst_week"), timescale.rolled_week(F.col("o_orderkey") % 1024, F.lit(2300)).alias("rolled"))


@register("g09_degrees", "WITH u AS (SELECT s_suppkey, s_acctbal / 100 AS a, CAST(round(abs(s_acctbal / 100) * 3600e6) AS BIGINT) AS u FROM supplier) SELECT s_suppkey, CASE WHEN a < 0 THEN -1 ELSE 1 END * (u // 3600000000) AS deg, u // 60000000 % 60 AS min, round((u % 60000000) / 1e6, 6) AS sec FROM u")
def degrees(spark, sf_dir) -> DataFrame:
    d, m, s = geodesy.dms(F.col("s_acctbal") / 100)
    return table(spark, sf_dir, "supplier").select("s_suppkey", d.alias("deg"), m.alias("min"), F.round(s, 6).alias("sec"))


POS_STEPS = ", p0 AS (SELECT *, z AS q FROM sta)" + "".join(f", p{i + 1} AS (SELECT * EXCLUDE (q), z + 6378137e0 / sqrt(1 - e2 * (q / sqrt(x * x + y * y + q * q)) * (q / sqrt(x * x + y * y + q * q))) * e2 * (q / sqrt(x * x + y * y + q * q)) AS q FROM p{i})" for i in range(6))


@register("g10_geodesy_round_trip", f"WITH {STA.replace('AS z FROM sta0', 'AS z, e2 FROM sta0')}{POS_STEPS} SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(degrees(atan(q / sqrt(x * x + y * y))), 8) AS lat2, round(degrees(atan2(y, x)), 8) AS lon2 FROM p6")
def geodesy_round_trip(spark, sf_dir) -> DataFrame:
    s = sta(spark, sf_dir)
    lat, lon, _ = geodesy.position(F.col("x"), F.col("y"), F.col("z"))
    return s.select("id", *[F.round(c, 3).alias(c) for c in "xyz"], F.round(F.degrees(lat), 8).alias("lat2"), F.round(F.degrees(lon), 8).alias("lon2"))


VIEW = f"""{STA}, {VSTA}, d AS (SELECT s.id, v.id AS vid, radians(s.lat) AS p, radians(s.lon) AS l, v.x * 4 - s.x AS dx, v.y * 4 - s.y AS dy, v.z * 4 - s.z AS dz, v.x * 4 AS sx, v.y * 4 AS sy, s.x AS rx, s.y AS ry FROM sta s JOIN vsta v ON v.id % 100 = s.id % 100),
u AS (SELECT *, -sin(l) * dx + cos(l) * dy AS e, -sin(p) * cos(l) * dx - sin(p) * sin(l) * dy + cos(p) * dz AS n, cos(p) * cos(l) * dx + cos(p) * sin(l) * dy + sin(p) * dz AS up FROM d)"""


#: Parts that the virtual stations of a remainder are dealt to: the pairs are many more than the rows.
PARTS = 8
SINES = ("sp", "cp", "sl", "cl")


def _view(spark, sf_dir) -> DataFrame:
    """Station and a point at four times a virtual station's distance from the earth's centre, as a satellite. The sides are dealt by
    remainder and part, by number, as few rows have very many partners."""
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = sta(spark, sf_dir).withColumns(dict(zip(SINES, geodesy.sines(F.radians("lat"), F.radians("lon")), strict=True)) | {"_m": F.col("id") % 100}).drop("lat", "lon", "h").withColumns({"_part": F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))})
    v = vsta(spark, sf_dir).select(F.col("id").alias("vid"), *[(F.col(c) * 4).alias(f"s{c}") for c in "xyz"])
    v = v.withColumns({"_m": F.col("vid") % 100, "_part": F.pmod(F.xxhash64("vid"), F.lit(PARTS)).cast("int")})
    return v.repartition(tasks, "_m", "_part").join(s, ["_m", "_part"]).drop("_m", "_part")


@register("g12_range_and_direction", f"""WITH {VIEW} SELECT id, vid, round(sqrt(dx * dx + dy * dy + dz * dz) + 7.2921151467e-5 * (sx * ry - sy * rx) / 299792458e0, 4) AS r,
round(degrees(CASE WHEN atan2(e, n) < 0 THEN atan2(e, n) + 2 * pi() ELSE atan2(e, n) END), 8) AS az, round(degrees(asin(up / sqrt(e * e + n * n + up * up))), 8) AS el FROM u""")
def range_and_direction(spark, sf_dir) -> DataFrame:
    x = _view(spark, sf_dir)
    c = lambda s: tuple(F.col(f"{s}{a}") for a in "xyz")
    d = tuple(F.col(f"s{a}") - F.col(a) for a in "xyz")
    x = x.select("id", "vid", geodesy.geometric_range(c("s"), c("")).alias("r"), *[v.alias(k) for k, v in zip("enu", geodesy.turned(tuple(F.col(k) for k in SINES), d), strict=True)])
    az, el = geodesy.direction(tuple(F.col(k) for k in "enu"))
    return x.select("id", "vid", F.round("r", 4).alias("r"), F.round(F.degrees(az), 8).alias("az"), F.round(F.degrees(el), 8).alias("el"))


ION = at.DEFAULT_ION
_c = lambda k: f"({ION[k]!r} + m * ({ION[k + 1]!r} + m * ({ION[k + 2]!r} + m * {ION[k + 3]!r})))"


@register("g13_klobuchar", f"""WITH {OBS}, a AS (SELECT o.srcid, o.epoch, o.sat, s.h, radians(s.lat) AS p, radians(s.lon) AS l, radians((o.sat * 67 + o.epoch * 29) % 360) AS az, radians(o.el) AS e, o.epoch * 7919 % 604800 AS tow FROM obs o JOIN ({f"WITH {STA} SELECT * FROM sta"}) s ON s.id = o.srcid + 1),
b AS (SELECT *, 0.0137e0 / (e / pi() + 0.11e0) - 0.022e0 AS psi FROM a), c AS (SELECT *, least(greatest(p / pi() + psi * cos(az), -0.416e0), 0.416e0) AS f FROM b), d AS (SELECT *, l / pi() + psi * sin(az) / cos(f * pi()) AS lam FROM c),
gm AS (SELECT *, f + 0.064e0 * cos((lam - 1.617e0) * pi()) AS m, 43200e0 * lam + tow AS t0 FROM d), k AS (SELECT *, t0 - floor(t0 / 86400e0) * 86400e0 AS t, greatest({_c(0)}, 0e0) AS amp, greatest({_c(4)}, 72000e0) AS per FROM gm), w AS (SELECT *, 2 * pi() * (t - 50400e0) / per AS x FROM k)
SELECT srcid, epoch, sat, round(299792458e0 * (1 + 16e0 * pow(0.53e0 - e / pi(), 3)) * CASE WHEN abs(x) < 1.57e0 THEN 5e-9 + amp * (1 + x * x * (-0.5e0 + x * x / 24e0)) ELSE 5e-9 END, 7) AS ion FROM w""")
def klobuchar(spark, sf_dir) -> DataFrame:
    s = sta(spark, sf_dir).select((F.col("id") - 1).alias("srcid"), "lat", "lon", "h")
    x = obs(spark, sf_dir).join(s, "srcid")
    delay = at.klobuchar(F.col("epoch") * 7919 % 604800, F.radians("lat"), F.radians("lon"), F.radians((F.col("sat") * 67 + F.col("epoch") * 29) % 360), F.radians("el"))
    return x.select("srcid", "epoch", "sat", F.round(delay, 7).alias("ion"))


@register("g14_saastamoinen", f"""WITH {STA}, a AS (SELECT id, radians(lat) AS p, greatest(h, 0e0) AS u, h, radians(5 + id % 85) AS el FROM sta), b AS (SELECT *, 1013.25e0 * pow(1 - 2.2557e-5 * u, 5.2568e0) AS pr, 15e0 - 6.5e-3 * u + 273.16e0 AS t FROM a)
SELECT id, CASE WHEN h < -100 OR h > 1e4 THEN 0 ELSE round(0.0022768e0 * pr / (1 - 0.00266e0 * cos(2 * p) - 0.00028e0 * u / 1e3) / cos(pi() / 2 - el) + 0.002277e0 * (1255e0 / t + 0.05e0) * (6.108e0 * 0.7e0 * exp((17.15e0 * t - 4684e0) / (t - 38.45e0))) / cos(pi() / 2 - el), 7) END AS trop, round(1 / cos(asin((6378137e0 + h) / (6378137e0 + 350000e0) * cos(el))), 8) AS ionmap FROM b""")
def saastamoinen(spark, sf_dir) -> DataFrame:
    el = F.radians(5 + F.col("id") % 85)
    return sta(spark, sf_dir).select("id", F.round(at.saastamoinen(F.radians("lat"), F.col("h"), el), 7).alias("trop"), F.round(at.ion_mapping(F.col("h"), el), 8).alias("ionmap"))


def _niell_sql() -> str:
    pick = lambda v: f"({list(v)!r}[k] * (1 - a) + {list(v)!r}[k + 1] * a)"
    frac = lambda x, y, z: f"((1 + {x} / (1 + {y} / (1 + {z}))) / (s + {x} / (s + {y} / (s + {z}))))"
    dry = [f"({pick(m)} - {pick(q)} * cs)" for m, q in zip(at.DRY_MEAN, at.DRY_SEASON, strict=True)]
    return f"round({frac(*dry)} + (1 / s - {frac(*map(repr, at.HEIGHT))}) * h / 1e3, 7) AS dry, round({frac(*map(pick, at.WET))}, 7) AS wet"


@register("g14_niell_mapping", f"""WITH {STA}, a AS (SELECT id, h, lat, sin(radians(5 + id % 85)) AS s, cos(2 * pi() * ((id % 365 + 1 - 28e0) / 365.25e0)) AS cs FROM sta), b AS (SELECT *, CAST(least(greatest(floor(lat / 15e0), 1), 4) AS INT) AS k FROM a), c AS (SELECT *, least(greatest(lat / 15e0 - k, 0), 1) AS a FROM b) SELECT id, {_niell_sql()} FROM c""")
def niell_mapping(spark, sf_dir) -> DataFrame:
    dry, wet = at.niell(F.col("id") % 365 + 1, F.radians("lat"), F.col("h"), F.radians(5 + F.col("id") % 85))
    return sta(spark, sf_dir).select("id", F.round(dry, 7).alias("dry"), F.round(wet, 7).alias("wet"))


@register("g16_tec_grid", """WITH g AS (SELECT CAST(p_partkey % 40 AS BIGINT) AS i, CAST(p_partkey % 25 AS BIGINT) AS j, avg(p_retailprice) / 100 AS tec FROM part GROUP BY 1, 2), q AS (SELECT c_custkey, CAST(floor(c_custkey * 0.37e0) AS BIGINT) % 38 AS i, CAST(floor(c_custkey * 0.73e0) AS BIGINT) % 24 AS j, c_custkey * 0.37e0 - floor(c_custkey * 0.37e0) AS a, c_custkey * 0.73e0 - floor(c_custkey * 0.73e0) AS b FROM customer),
c AS (SELECT q.c_custkey, q.a, q.b, g.tec, g.i - q.i AS di, g.j - q.j AS dj FROM q JOIN g ON g.i - q.i BETWEEN 0 AND 1 AND g.j - q.j BETWEEN 0 AND 1 WHERE g.tec > 0),
s AS (SELECT c_custkey, count(*) AS n, sum(tec * CASE di WHEN 1 THEN a ELSE 1 - a END * CASE dj WHEN 1 THEN b ELSE 1 - b END) AS bil, avg(tec) AS mean, max(tec) FILTER (di = CASE WHEN a <= 0.5 THEN 0 ELSE 1 END AND dj = CASE WHEN b <= 0.5 THEN 0 ELSE 1 END) AS near FROM c GROUP BY c_custkey)
SELECT c_custkey, n, round(CASE WHEN n = 4 THEN bil ELSE coalesce(near, mean) END * 0.190293672798365, 6) AS tec FROM s""")
def tec_grid(spark, sf_dir) -> DataFrame:
    """Bilinear where all four corners have a value, else the nearest corner, else the mean of those there are."""
    p = table(spark, sf_dir, "part")
    g = p.groupBy((F.col("p_partkey") % 40).alias("gi"), (F.col("p_partkey") % 25).alias("gj")).agg((F.avg("p_retailprice") / 100).alias("tec"))
    x, y = F.col("c_custkey") * 0.37e0, F.col("c_custkey") * 0.73e0
    q = table(spark, sf_dir, "customer").select("c_custkey", (F.floor(x) % 38).alias("i"), (F.floor(y) % 24).alias("j"), (x - F.floor(x)).alias("a"), (y - F.floor(y)).alias("b"))
    q = q.withColumn("di", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("dj", F.explode(F.array(F.lit(0), F.lit(1))))
    c = q.join(g, (F.col("gi") == F.col("i") + F.col("di")) & (F.col("gj") == F.col("j") + F.col("dj"))).filter("tec > 0")
    w = F.when(F.col("di") == 1, F.col("a")).otherwise(1 - F.col("a")) * F.when(F.col("dj") == 1, F.col("b")).otherwise(1 - F.col("b"))
    near = (F.col("di") == F.when(F.col("a") <= 0.5, 0).otherwise(1)) & (F.col("dj") == F.when(F.col("b") <= 0.5, 0).otherwise(1))
    s = c.groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum(F.col("tec") * w).alias("bil"), F.avg("tec").alias("mean"), F.max(F.when(near, F.col("tec"))).alias("near"))
    return s.select("c_custkey", "n", F.round(F.when(F.col("n") == 4, F.col("bil")).otherwise(F.coalesce("near", "mean")) * 0.190293672798365, 6).alias("tec"))


NEWTON = "".join(f", k{i + 1} AS (SELECT * EXCLUDE (u), u - (u - ec * sin(u) - m) / (1 - ec * cos(u)) AS u FROM k{i})" for i in range(8))


@register("g17_kepler_equation", f"WITH k0 AS (SELECT o_orderkey, (o_totalprice - floor(o_totalprice / 6.28e0) * 6.28e0) - 3.14e0 AS m, (o_custkey % 200) / 10000e0 AS ec, (o_totalprice - floor(o_totalprice / 6.28e0) * 6.28e0) - 3.14e0 AS u FROM orders){NEWTON} SELECT o_orderkey, round(u, 9) + 0e0 AS e, round(atan2(sqrt(1 - ec * ec) * sin(u), cos(u) - ec), 9) + 0e0 AS v FROM k8")
def kepler_equation(spark, sf_dir) -> DataFrame:
    """Eccentric and true anomaly by eight Newton steps."""
    m = F.col("o_totalprice") - F.floor(F.col("o_totalprice") / 6.28e0) * 6.28e0 - 3.14e0
    x = table(spark, sf_dir, "orders").select("o_orderkey", m.alias("m"), ((F.col("o_custkey") % 200) / 10000e0).alias("ec"))
    u = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.col("m"), lambda u, _: u - (u - F.col("ec") * F.sin(u) - F.col("m")) / (1 - F.col("ec") * F.cos(u)))
    x = x.withColumn("u", u)
    return x.select("o_orderkey", F.round("u", 9).alias("e"), F.round(F.atan2(F.sqrt(1 - F.col("ec") * F.col("ec")) * F.sin("u"), F.cos("u") - F.col("ec")), 9).alias("v"))


@register("g19_ssr_age_gate", """WITH s AS (SELECT user_id AS sat, epoch_us(ts) / 1e6 AS t0, value, event_id FROM events WHERE event_type = 'click'), q AS (SELECT user_id AS sat, epoch_us(ts) / 1e6 AS t, event_id AS q FROM events WHERE event_type <> 'click')
SELECT q.sat, q.q, s.event_id AS ssr, round(s.value * (q.t - s.t0) * 1e-4 * 0.190293672798365, 6) AS dr FROM q JOIN s ON s.sat = q.sat AND abs(q.t - s.t0) <= 86400 QUALIFY row_number() OVER (PARTITION BY q.q ORDER BY abs(q.t - s.t0), s.event_id DESC) = 1""")
def ssr_age_gate(spark, sf_dir) -> DataFrame:
    """The nearest correction within its age limit, with its rate applied."""
    from ..operators import timejoin

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("sat"), (F.expr("unix_micros(cast(ts as timestamp))") / 1e6).alias("t"), "event_id", "event_type", "value")
    s = e.filter("event_type = 'click'").select("sat", F.col("t").alias("t0"), F.col("event_id").alias("ssr"), "value")
    q = e.filter("event_type <> 'click'").select("sat", "t", F.col("event_id").alias("q"))
    got = timejoin.nearest(q, s, ["sat"], "t", "t0", 86400.0, [F.col("ssr")])
    return got.select("sat", "q", "ssr", F.round(F.col("value") * (F.col("t") - F.col("t0")) * 1e-4 * 0.190293672798365, 6).alias("dr"))


@register("g22_error_models", f"""WITH {OBS} SELECT srcid, epoch, sat, round(1e4 * (0.003e0 * 0.003e0 + 0.003e0 * 0.003e0 / sin(radians(greatest(el, 5)))), 8) AS spp, round(2 * (0.003e0 * 0.003e0 + 0.003e0 * 0.003e0 / sin(radians(el)) / sin(radians(el))) + pow(299792458e0 * 5e-12 * epoch, 2), 6) AS rtk,
round((l - pow(1575.42e0 / 1227.60e0, 2) * p) / (1 - pow(1575.42e0 / 1227.60e0, 2)), 6) AS iflc FROM obs""")
def error_models(spark, sf_dir) -> DataFrame:
    el = F.radians("el")
    rtk = codes.rtk_variance(el, F.lit(0.0), F.col("epoch"), F.lit(1.0))
    return obs(spark, sf_dir).select("srcid", "epoch", "sat", F.round(codes.spp_variance(el, F.lit(1.0)), 8).alias("spp"), F.round(rtk, 6).alias("rtk"), F.round(codes.iono_free(F.col("p"), F.col("l"), 1575.42, 1227.60), 6).alias("iflc"))


@register("g23_path_template", "SELECT event_id, replace(replace(replace('/data/%Y/%n/%r.obs', '%Y', strftime(ts, '%Y')), '%n', lpad(CAST(dayofyear(ts) AS VARCHAR), 3, '0')), '%r', CAST(user_id AS VARCHAR)) AS path FROM events")
def path_template(spark, sf_dir) -> DataFrame:
    from ..functions import paths

    return table(spark, sf_dir, "events").select("event_id", paths.fill("/data/%Y/%n/%r.obs", F.col("ts").cast("timestamp"), F.col("user_id").cast("string")).alias("path"))


@register("g25_option_lines", r"""WITH l AS (SELECT page_id, unnest(string_split(regexp_replace(url, '[?&/]', chr(10), 'g'), chr(10))) AS line FROM pages) SELECT page_id, trim(split_part(line, '=', 1)) AS key, trim(regexp_replace(substr(line, instr(line, '=') + 1), '#.*', '')) AS value FROM l WHERE instr(line, '=') > 1""")
def option_lines(spark, sf_dir) -> DataFrame:
    from ..sources import configs

    lines = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split(F.regexp_replace("url", "[?&/]", "\n"), "\n")).alias("line"))
    return configs.options(lines, "line").select("page_id", "key", "value")


@register("a20_nmea_gga", f"""WITH {STA}, d AS (SELECT id, CAST(floor(lat) AS BIGINT) AS dg, (lat - floor(lat)) * 60 AS mn, CAST(floor(lon) AS BIGINT) AS dl, (lon - floor(lon)) * 60 AS ml, h FROM sta) SELECT id, round(dg + round(mn, 7) / 60, 8) AS lat, round(dl + round(ml, 7) / 60, 8) AS lon, round(h, 3) AS h, 1 AS quality FROM d""")
def nmea_gga(spark, sf_dir) -> DataFrame:
    """Stations written as sentences and read back."""
    s = sta(spark, sf_dir)
    line = nmea.gga(F.lit(43200), F.col("lat"), F.col("lon"), F.col("h"), F.lit(1), F.lit(8), F.lit(1.0))
    got = nmea.parse_gga(s.select("id", line.alias("line")), "line")
    return got.filter("valid").select("id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "h", "quality")
