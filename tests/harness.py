"""Run a query and its SQL over one folder of tables and compare them."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = os.path.join(sf_dir, name)
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _plain(v: object) -> object:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        return _plain(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """Empty when they agree, else what differs."""
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} rows against {len(b)}; ours only {only_a}; SQL only {only_b}"
