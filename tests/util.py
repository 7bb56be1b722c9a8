"""Running a query on both engines."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str = "sf0.001") -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, sorted, with plain Python values."""

    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float | np.floating) and np.isnan(x):
            return None
        if isinstance(x, bool | np.bool_):
            return bool(x)
        if isinstance(x, float | np.floating):
            return round(float(x), 9)
        return int(x) if isinstance(x, int | np.integer) else x

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


def same(query, oracle: str, spark, sf: str = "sf0.001") -> None:
    got, want = query(spark, f"{DATA}/{sf}").toPandas(), duck(sf).sql(oracle).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
