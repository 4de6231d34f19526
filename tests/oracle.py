"""Rows of a Spark result and of its DuckDB SQL in one comparable form."""

import math

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(_plain, v))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return f"{float(v):.9g}" if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def rows(df):
    return sorted(tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
