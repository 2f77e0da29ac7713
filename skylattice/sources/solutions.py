"""Solution text: one line a position, by fields of fixed format, with a comment header that names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a position line after its two time fields (fixed order).
LLH = ("lat", "lon", "height", "quality", "ns", "sdn", "sde", "sdu", "sdne", "sdeu", "sdun", "age", "ratio")
XYZ = ("x", "y", "z", "quality", "ns", "sdx", "sdy", "sdz", "sdxy", "sdyz", "sdzx", "age", "ratio")
ENU = ("e", "n", "u", "quality", "ns", "sde", "sdn", "sdu", "sden", "sdnu", "sdue", "age", "ratio")
KINDS = {"llh": (LLH, ("%14.9f", "%14.9f", "%10.4f")), "xyz": (XYZ, ("%14.4f",) * 3), "enu": (ENU, ("%14.4f",) * 3)}


def signed_root(v: Column) -> Column:
    return F.signum(v) * F.sqrt(F.abs(v))


def lines(sol: DataFrame, kind: str = "llh", max_std: float = 0.0) -> DataFrame:
    """sol: t (s since 1970, GPS time), the three coordinates, quality, ns, six standard deviations, age, ratio. Rows without a
    solution, or with a deviation over max_std, are left out. Returns t and line."""
    names, formats = KINDS[kind]
    x = sol.filter(F.col("quality") > 0)
    if max_std > 0:
        x = x.filter(F.sqrt(sum(F.col(c) * F.col(c) for c in names[5:8])) <= max_std)
    clock = F.concat(F.date_format(F.timestamp_seconds(F.floor("t")), "yyyy/MM/dd HH:mm:ss"), F.substring(F.format_string("%.3f", (F.col("t") - F.floor("t")).cast("double")), 2, 4))
    body = F.format_string(" ".join(["%s", *formats, "%3d", "%3d", *["%8.4f"] * 6, "%6.2f", "%6.1f"]), clock, *[F.col(c) for c in names])
    return x.select("t", body.alias("line"))


def header(kind: str, program: str = "skylattice") -> list[str]:
    return [f"% program: {program}", "% time system: GPST", f"% {'GPST':<22} {' '.join(KINDS[kind][0])}"]


def parse(text: DataFrame, line: str, kind: str = "llh", since: float | None = None, until: float | None = None, interval: float = 0.0, quality: int = 0) -> DataFrame:
    """Columns t and those of the kind, from lines that aren't comments; filtered by time, interval and quality."""
    names = KINDS[kind][0]
    f = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    x = text.filter(~F.col(line).startswith("%") & (F.trim(line) != "")).withColumn("_f", f).filter(F.size("_f") >= 2 + len(names))
    sec = F.try_to_timestamp(F.concat_ws(" ", F.col("_f")[0], F.split(F.col("_f")[1], r"\.")[0]), F.lit("yyyy/MM/dd HH:mm:ss"))
    t = F.unix_seconds(sec) + F.concat(F.lit("0."), F.coalesce(F.try_element_at(F.split(F.col("_f")[1], r"\."), F.lit(2)), F.lit("0"))).cast("double")
    kinds = {"quality": "int", "ns": "int"}
    x = x.withColumn("t", t).select(*[c for c in text.columns if c != line], "t", *[F.col("_f")[i + 2].try_cast(kinds.get(n, "double")).alias(n) for i, n in enumerate(names)])
    for cond in (F.col("t") >= since if since is not None else None, F.col("t") <= until if until is not None else None, F.pmod(F.col("t") + 0.0125, F.lit(interval)) <= 0.025 if interval > 0 else None, F.col("quality") == quality if quality else None):
        x = x.filter(cond) if cond is not None else x
    return x.filter("t IS NOT NULL")


def write(sol: DataFrame, path: str, kind: str = "llh") -> None:
    """Sorted by time over all files; the header stands in a file of its own that sorts first."""
    spark = sol.sparkSession
    spark.createDataFrame([(v,) for v in header(kind)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    lines(sol, kind).orderBy("t").select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/solution")
