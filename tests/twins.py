"""Compares a query with its SQL twin."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating, decimal.Decimal)):
        return str(int(x)) if float(x).is_integer() else f"{float(x):.6g}"
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if isinstance(x, (list, np.ndarray)):
        return str([plain(v) for v in x])
    if isinstance(x, (datetime.date, datetime.datetime, pd.Timestamp)):
        t = pd.Timestamp(x)
        return (t.tz_localize(None) if t.tzinfo else t).isoformat()
    return str(x)


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)
