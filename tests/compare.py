"""Order-insensitive comparison of a Spark result with a DuckDB one."""

import duckdb
import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def one(v):
        if v is None or str(v) in ("<NA>", "NaT") or (isinstance(v, float) and np.isnan(v)):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        return round(float(v), 9) + 0.0 if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(str([one(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))
