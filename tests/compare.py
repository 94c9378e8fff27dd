"""Rows of a Spark query against rows of its DuckDB twin."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

from rookery.plans.views import BASE


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(sf_dir, name)}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 6) + 0.0
    return str(v)


def rows_of(frame: pd.DataFrame, columns: list[str]) -> list[str]:
    return sorted(repr([plain(v) for v in row]) for row in frame[columns].astype(object).values.tolist())


def assert_same(df, con, sql: str) -> None:
    want, got = con.execute(sql).df(), df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)
