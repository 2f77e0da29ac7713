"""Position sentences (GGA) as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import xor_checksum

#: Solution status -> quality digit of the sentence: none, fix, float, SBAS, DGPS, single, PPP (fixed values).
QUALITY = (0, 4, 5, 9, 2, 1, 3)


def _degmin(angle: Column, width: int) -> Column:
    """dddmm.mmmmmmm of an absolute angle in degrees, rounded once so that 60 minutes carry."""
    units = F.round(F.abs(angle) * 60e7).cast("long")
    deg, rest = F.floor(units / 600000000).cast("long"), units % 600000000
    return F.concat(F.lpad(deg.cast("string"), width, "0"), F.lpad(F.floor(rest / 10000000).cast("string"), 2, "0"), F.lit("."), F.lpad((rest % 10000000).cast("string"), 7, "0"))


def gga(second: Column, lat: Column, lon: Column, height: Column, quality: Column, n_sat: Column, hdop: Column, geoid: float = 0.0) -> Column:
    """second: of the UTC day. Ends with the checksum."""
    hms = F.format_string("%02d%02d%02d.00", F.floor(second / 3600).cast("int"), (F.floor(second / 60) % 60).cast("int"), (second % 60).cast("int"))
    body = F.concat_ws(",", F.lit("GPGGA"), hms, _degmin(lat, 2), F.when(lat >= 0, "N").otherwise("S"), _degmin(lon, 3), F.when(lon >= 0, "E").otherwise("W"), quality.cast("string"), F.lpad(n_sat.cast("string"), 2, "0"), F.format_string("%.1f", hdop), F.format_string("%.3f", height - geoid), F.lit("M"), F.format_string("%.3f", F.lit(geoid)), F.lit("M"), F.lit("1.0"), F.lit(""))
    return F.concat(F.lit("$"), body, F.lit("*"), xor_checksum(body))


def parse_gga(df: DataFrame, line: str) -> DataFrame:
    """Adds second, lat, lon (degrees), h (with geoid height), quality, n_sat and valid (checksum and fields good)."""
    body = F.regexp_extract(line, r"^\$(.*)\*[0-9A-Fa-f]{2}\s*$", 1)
    f = F.split(body, ",")
    x = df.withColumn("_f", f).withColumn("_ok", (xor_checksum(body) == F.upper(F.regexp_extract(line, r"\*([0-9A-Fa-f]{2})\s*$", 1))) & (F.size(f) >= 12) & F.substring(body, 3, 3).eqNullSafe(F.lit("GGA")))
    field = lambda i: F.try_element_at("_f", F.lit(i + 1))
    number = lambda i: field(i).try_cast("double")
    angle = lambda i: (F.floor(number(i) / 100) + (number(i) - F.floor(number(i) / 100) * 100) / 60) * F.when(field(i + 1).isin("S", "W"), -1).otherwise(1)
    clock = F.floor(number(1) / 10000) * 3600 + F.floor(number(1) % 10000 / 100) * 60 + number(1) % 100
    out = x.withColumns({"second": clock, "lat": angle(2), "lon": angle(4), "h": F.round(number(9) + F.coalesce(number(11), F.lit(0.0)), 3), "quality": field(6).try_cast("int"), "n_sat": field(7).try_cast("int")})
    return out.withColumn("valid", F.coalesce(F.col("_ok") & F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.lit(False))).drop("_f", "_ok")
