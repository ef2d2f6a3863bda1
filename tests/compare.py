"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, str):
            return x
        try:
            return repr(round(float(x), 5) + 0.0)
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False))


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con.sql(sql).df()
