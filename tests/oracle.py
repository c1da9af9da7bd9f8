"""Comparison of a query with its SQL in DuckDB."""

import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def tables(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def value(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return ""
    if isinstance(v, (float, np.floating)):
        return "" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return f"{float(v):.6g}" if abs(v) < 1e5 else str(int(v))
    return v.isoformat().replace("+00:00", "") if hasattr(v, "isoformat") else str(v)


def bag(frame, columns):
    return Counter(tuple(map(value, row)) for row in frame[columns].itertuples(index=False))


def same(df, con, sql):
    got, want = df.toPandas(), con.execute(sql).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = bag(got, columns), bag(want, columns)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
