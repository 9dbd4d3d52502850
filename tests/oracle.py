"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connection(path: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{path}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        source = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, np.integer)):
            return float(v)
        if isinstance(v, (float, np.floating)):
            return float(v) + 0.0
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if isinstance(v, np.ndarray):
            return tuple(v.tolist())
        return v

    rows = [tuple(cell(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty if both have the same columns and rows; queries and SQL round floats alike, so they must be equal."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = canonical(ours), canonical(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            if u != v and not (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1e-9 * max(1.0, abs(u))):
                return f"{sorted(ours.columns)}: {x} and {y}"
    return ""
