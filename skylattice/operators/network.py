"""Views over the network's tables, and changes to its control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy


def navigation(eph: DataFrame, now: float, longest: float) -> DataFrame:
    """Adds valid: a time is set, the satellite is healthy and the time is near."""
    return eph.withColumn("valid", (F.col("toe") != 0) & (F.col("svh") == 0) & (F.abs(F.lit(now) - F.col("toe")) <= longest))


def latest(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Rows of each key's last time."""
    last = df.groupBy(*keys).agg(F.max(t).alias("_last"))
    return df.join(last, keys).filter(F.col(t) == F.col("_last")).drop("_last")


def baseline_views(df: DataFrame) -> DataFrame:
    """df: lat, lon (degrees), x, y, z of the base and rx, ry, rz of the rover. Adds e, n, u, length, pitch and yaw (degrees)."""
    d = tuple(F.col(f"r{c}") - F.col(c) for c in "xyz")
    e, n, u = geodesy.to_enu(F.radians("lat"), F.radians("lon"), d)
    x = df.withColumns({"e": e, "n": n, "u": u})
    yaw, pitch = geodesy.direction((F.col("e"), F.col("n"), F.col("u")))
    return x.withColumns({"length": F.sqrt(F.col("e") * F.col("e") + F.col("n") * F.col("n") + F.col("u") * F.col("u")), "pitch": F.degrees(pitch), "yaw": F.degrees(yaw)})


def apply_changes(table: DataFrame, added: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The table without removed keys, with added rows whose keys it doesn't have."""
    kept = table.join(removed.select(key), key, "left_anti")
    return kept.unionByName(added.join(kept.select(key), key, "left_anti"))


class Engine:
    """The network as named tables: what is set here is what the views and operators read."""

    def __init__(self, **tables: DataFrame):
        self.tables = dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def add(self, name: str, rows: DataFrame, key: str = "name") -> DataFrame:
        self.tables[name] = apply_changes(self.tables[name], rows, rows.limit(0), key) if name in self.tables else rows
        return self.tables[name]

    def delete(self, name: str, keys: DataFrame, key: str = "name") -> DataFrame:
        self.tables[name] = self.tables[name].join(keys.select(key), key, "left_anti")
        return self.tables[name]

    def observations(self, source: str) -> DataFrame:
        return latest(self["obs"].join(self["sources"].filter(F.col("name") == source).select("srcid"), "srcid"), ["srcid"], "epoch")

    def navigation(self, now: float, longest: float = 7200.0) -> DataFrame:
        return navigation(self["eph"], now, longest)

    def sources(self) -> DataFrame:
        """Without credentials."""
        return self["sources"].drop("user", "password")
