"""File name templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keyword -> date format (fixed values).
FORMATS = (("%Y", "yyyy"), ("%y", "yy"), ("%m", "MM"), ("%d", "dd"), ("%h", "HH"), ("%M", "mm"), ("%S", "ss"), ("%n", "DDD"))


def fill(template: str, ts: Column, station: Column) -> Column:
    """The template with its time keywords, and %r by the station's name."""
    out = F.lit(template)
    for key, pattern in FORMATS:
        if key in template:
            out = F.replace(out, F.lit(key), F.date_format(ts, pattern))
    return F.replace(out, F.lit("%r"), station) if "%r" in template else out
