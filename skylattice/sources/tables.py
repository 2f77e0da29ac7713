"""Small text tables: code biases, station positions, ocean loading, earth orientation, leap seconds, correction message logs, polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.orbit import once

NS = 299792458.0 * 1e-9


def code_biases(lines: DataFrame, line: str, order: str) -> DataFrame:
    """kind (P1-P2, P1-C1 or P2-C2, from the last title above), sat or station, and bias in metres. Zero values are left out."""
    title = F.when(F.instr(line, "DIFFERENTIAL (P1-P2) CODE BIASES") > 0, "P1-P2").when(F.instr(line, "DIFFERENTIAL (P1-C1) CODE BIASES") > 0, "P1-C1").when(F.instr(line, "DIFFERENTIAL (P2-C2) CODE BIASES") > 0, "P2-C2")
    above = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # a bias file has some hundred lines
    x = lines.withColumn("kind", F.last(title, ignorenulls=True).over(above))
    value = F.trim(F.substring(line, 27, 9)).try_cast("double")
    head = F.trim(F.substring(line, 1, 6))
    named = F.trim(F.substring(line, 7, 20))
    x = x.withColumn("value", value).filter("kind IS NOT NULL AND value IS NOT NULL AND value != 0")
    is_sat = head.rlike("^[A-Z][0-9 ]?[0-9]$")
    return x.select("kind", F.when(is_sat, head).alias("sat"), F.when(~is_sat | (named != ""), F.when(named != "", named)).alias("station"), (F.col("value") * NS).alias("bias"))


def station_positions(lines: DataFrame, line: str) -> DataFrame:
    """name, lat, lon (degrees), height of `lat lon height name` lines; comments start with %."""
    f = F.split(F.trim(F.regexp_replace(F.regexp_replace(line, "%.*", ""), r"\s+", " ")), " ")
    x = lines.withColumn("_f", f).filter(F.size("_f") >= 4)
    get = lambda i: F.col("_f")[i].try_cast("double")
    return x.select(F.col("_f")[3].alias("name"), get(0).alias("lat"), get(1).alias("lon"), get(2).alias("height")).filter("lat IS NOT NULL AND lon IS NOT NULL AND height IS NOT NULL")


#: Rows of a station's block in a loading file, in their order.
LOADING = ("up", "west", "south", "up_lag", "west_lag", "south_lag")


def ocean_loading(lines: DataFrame, line: str, order: str, file: str) -> DataFrame:
    """station (upper case) and waves, an array of structs of LOADING, one for each of eleven constituents: metres and degrees. A block is a
    line with the station's name and six lines of eleven numbers; `$$` lines are comments; shorter blocks are left out, and rows after
    the sixth don't count. Of a file's blocks of one name the first stays."""
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    f = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    row = F.col(line).rlike(rf"^\s*{number}(?:\s+{number}){{10}}")
    x = lines.filter(~F.col(line).startswith("$$") & (F.trim(line) != "")).withColumns({"_row": row, "_f": f})
    above = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # a file has some thousand stations at most
    x = x.withColumn("_block", F.last(F.when(~F.col("_row"), F.struct(F.col(order).alias("at"), F.upper(F.substring(F.col("_f")[0], 1, 16)).alias("name"))), ignorenulls=True).over(above))
    rows = F.struct(F.col(order).alias("at"), F.transform(F.slice("_f", 1, 11), lambda v: v.try_cast("double")).alias("v"))
    g = x.filter("_row AND _block IS NOT NULL").groupBy(F.col(file).alias("_file"), "_block").agg(F.sort_array(F.collect_list(rows)).alias("_r")).filter(F.size("_r") >= 6)
    each = lambda i: F.struct(*[F.col("_r")[k]["v"][i].alias(n) for k, n in enumerate(LOADING)])
    g = g.select("_file", "_block", F.array(*[each(i) for i in range(11)]).alias("waves"))
    return g.groupBy("_file", F.col("_block.name").alias("station")).agg(F.min_by("waves", "_block.at").alias("waves")).drop("_file")


def earth_orientation(lines: DataFrame, line: str) -> DataFrame:
    """mjd, xp, yp (arc seconds), ut1_utc (s), lod, by number fields of 1e-6 and 1e-7 units as in the service's tables."""
    f = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    x = lines.withColumn("_f", f).filter(F.size("_f") >= 5)
    get = lambda i, scale: (F.col("_f")[i].try_cast("double") * scale)
    return x.select(get(0, 1.0).alias("mjd"), get(1, 1e-6).alias("xp"), get(2, 1e-6).alias("yp"), get(3, 1e-7).alias("ut1_utc"), get(4, 1e-7).alias("lod")).filter("mjd IS NOT NULL AND xp IS NOT NULL")


def leap_seconds(lines: DataFrame, line: str) -> DataFrame:
    """start (UTC calendar second) and ahead (s of GPS time) of `y m d h m s ahead` lines."""
    f = F.split(F.trim(F.regexp_replace(F.regexp_replace(line, "#.*", ""), r"\s+", " ")), " ")
    x = lines.withColumn("_f", f).filter(F.size("_f") >= 7)
    at = F.try_to_timestamp(F.format_string("%s-%s-%s %s:%s:%s", *[F.lpad(F.col("_f")[i], 4 if i == 0 else 2, "0") for i in range(6)]))
    return x.select(F.unix_seconds(at).alias("start"), F.abs(F.col("_f")[6].try_cast("int")).alias("ahead")).filter("start IS NOT NULL")


def correction_log(lines: DataFrame, line: str, prn: int = 0) -> DataFrame:
    """week, tow, prn and the 29-byte message of `week tow prn type : hex` lines and of the two receiver formats whose fields are
    comma-separated after `#RAWWAASFRAMEA` and `$FRMA`."""
    hexes = F.regexp_extract(line, r":\s*([0-9A-Fa-f]+)\s*$", 1)
    own = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    body = F.split(F.col(line), ";")
    head, tail = F.split(body[0], ","), F.split(F.coalesce(F.try_element_at(body, F.lit(2)), F.lit("")), ",")
    old = F.split(F.col(line), ",")
    pick = lambda a, i: F.try_element_at(a, F.lit(i))
    four = F.col(line).startswith("#RAWWAASFRAMEA")
    three = F.col(line).startswith("$FRMA")
    lines = lines.select(once(F.col(line)).alias(line))  # fields and filter use it many times
    x = lines.select(
        F.when(four, pick(head, 6)).when(three, pick(old, 2)).otherwise(pick(own, 1)).try_cast("int").alias("week"),
        F.when(four, pick(head, 7)).when(three, pick(old, 3)).otherwise(pick(own, 2)).try_cast("double").cast("long").alias("tow"),
        F.when(four, pick(tail, 2)).when(three, pick(old, 4)).otherwise(pick(own, 3)).try_cast("int").alias("prn"),
        F.when(four, pick(tail, 4)).when(three, F.regexp_replace(pick(old, 6), r"\*.*", "")).otherwise(hexes).alias("hex"),
    )
    x = x.select(once(F.struct("week", "tow", "prn", "hex")).alias("_x")).select("_x.*")
    x = x.filter("week IS NOT NULL AND tow IS NOT NULL AND prn IS NOT NULL AND length(hex) >= 56").withColumn("msg", F.unhex(F.rpad(F.substring("hex", 1, 58), 58, "0"))).drop("hex")
    return x.filter(F.col("prn") == prn) if prn else x


def correction_lines(messages: DataFrame) -> DataFrame:
    """line of week, tow, prn and msg; the type is the six bits after the preamble."""
    kind = F.shiftright(F.conv(F.hex(F.substring("msg", 2, 1)), 16, 10).cast("int"), 2)
    return messages.select(F.format_string("%4d %6d %3d %2d : %s", "week", "tow", "prn", kind, F.hex("msg")).alias("line"))


def polygon(lines: DataFrame, line: str, order: str, name: str) -> DataFrame:
    """One ring for each name from `[lon,lat],` lines in their order."""
    m = r"\[\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)\s*\]"
    p = lines.filter(F.col(line).rlike(m)).select(name, F.struct(F.col(order), F.regexp_extract(line, m, 1).cast("double").alias("x"), F.regexp_extract(line, m, 2).cast("double").alias("y")).alias("p"))
    return p.groupBy(name).agg(F.transform(F.sort_array(F.collect_list("p")), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("ring"))
