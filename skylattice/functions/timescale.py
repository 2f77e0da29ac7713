"""Time scales on whole seconds since 1970 (calendar, without leap seconds) and a fraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calendar seconds of the starts of GPS, Galileo and BeiDou time: 1980-01-06, 1999-08-22, 2006-01-01 (fixed values).
GPS0, GST0, BDT0 = 315964800, 935280000, 1136073600
WEEK = 604800
#: UTC calendar second from which GPS time is so many seconds ahead (fixed values).
LEAPS = (
    (1483228800, 18), (1435708800, 17), (1341100800, 16), (1230768000, 15), (1136073600, 14), (915148800, 13), (867715200, 12), (820454400, 11), (773020800, 10),
    (741484800, 9), (709948800, 8), (662688000, 7), (631152000, 6), (567993600, 5), (489024000, 4), (425865600, 3), (394329600, 2), (362793600, 1),
)


def week_of(t: Column, origin: int = GPS0) -> tuple[Column, Column]:
    """Week number and second of the week."""
    return F.floor((t - origin) / WEEK).cast("long"), F.pmod(t - origin, F.lit(WEEK)).cast("long")


def from_week(week: Column, tow: Column, origin: int = GPS0) -> Column:
    return origin + week * WEEK + tow


def _leap(t: Column, ahead: int) -> Column:
    out = F.lit(0)
    for start, n in reversed(LEAPS):
        out = F.when(t >= start + ahead * n, n).otherwise(out)
    return out.cast("long")


def utc_to_gps(t: Column) -> Column:
    return t + _leap(t, 0)


def gps_to_utc(t: Column) -> Column:
    return t - _leap(t, 1)


def gps_to_bdt(t: Column) -> Column:
    return t - 14


def rolled_week(week: Column, current: Column) -> Column:
    """A 10-bit week number in full, near the current week."""
    return week + F.floor((current - week + 512) / 1024).cast("long") * 1024


def day_of_year(t: Column) -> Column:
    return F.dayofyear(F.timestamp_seconds(t)).cast("long")


def nearest_day(second_of_day: Column, reference: Column) -> Column:
    """Full time of a second of the day within half a day of the reference."""
    base = F.floor(reference / 86400).cast("long") * 86400 + second_of_day
    return base + F.when(base - reference > 43200, -86400).when(base - reference < -43200, 86400).otherwise(0)
