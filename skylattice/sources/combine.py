"""Merging of readings from several files: the later file's present value wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def later_wins(df: DataFrame, keys: list[str], values: list[str], file: str = "file") -> DataFrame:
    """One row a key; each value is that of the last file that has one (neither null nor zero)."""
    last = lambda v: F.max_by(F.col(v), F.when(F.col(v).isNotNull() & (F.col(v) != 0), F.col(file))).alias(v)
    return df.groupBy(*keys).agg(*[last(v) for v in values])
