"""Configuration text: option files and comma-separated control tables ended by '#'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geodesy

#: Columns of the control tables, by kind (fixed order of the files).
TABLES = {
    "sources": ("name", "address", "port", "user", "password", "mountpoint", "lat", "lon", "height", "kind"),
    "baselines": ("base", "rover"),
    "virtual_stations": ("name", "x", "y", "z"),
    "users": ("name", "password"),
    "catalog": ("id", "address", "province", "city", "lat", "lon", "height", "itrf", "type"),
}
LEAST = {"sources": 6, "baselines": 2, "virtual_stations": 4, "users": 2, "catalog": 9}
NUMBERS = {"port": "int", "lat": "double", "lon": "double", "height": "double", "x": "double", "y": "double", "z": "double", "itrf": "int", "type": "int"}


def options(lines: DataFrame, line: str) -> DataFrame:
    """key and value of `key = value # comment` lines; other lines go."""
    at = F.instr(line, "=")
    out = lines.filter(at > 1).withColumn("key", F.trim(F.substring(F.col(line), F.lit(1), at - 1)))
    return out.withColumn("value", F.trim(F.regexp_replace(F.substring(F.col(line), at + 1, F.length(line)), "#.*", "")))


def parse(lines: DataFrame, line: str, kind: str, order: str) -> DataFrame:
    """Rows of a control table; short lines go, and of equal first fields the first line stays. Passwords are not among the columns."""
    fields = F.transform(F.split(F.regexp_replace(line, "#.*", ""), ","), lambda v: F.trim(v))
    names = TABLES[kind]
    x = lines.withColumn("_f", fields).filter(F.size("_f") >= LEAST[kind])
    get = lambda i, n: F.try_element_at("_f", F.lit(i + 1)).try_cast(NUMBERS.get(n, "string")).alias(n)
    x = x.select(order, *[get(i, n) for i, n in enumerate(names) if n != "password"])
    keys = ["base", "rover"] if kind == "baselines" else [names[0]]
    w = Window.partitionBy(*keys).orderBy(order)
    x = x.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    if kind in ("sources", "catalog"):
        xyz = geodesy.ecef(F.radians(F.coalesce("lat", F.lit(0.0))), F.radians(F.coalesce("lon", F.lit(0.0))), F.coalesce("height", F.lit(0.0)))
        x = x.withColumns(dict(zip("xyz", xyz, strict=True)))
    return x


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A control file; lines are numbered by their place in the file, which is small and one split."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return parse(lines, "line", kind, "line_no")


def read_options(spark: SparkSession, path: str) -> dict[str, str]:
    rows = options(spark.read.text(path).toDF("line"), "line").select("key", "value").collect()  # an option file has tens of lines
    return {r["key"]: r["value"] for r in rows}
