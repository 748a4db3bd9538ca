"""Compares queries with their SQL in DuckDB."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(x) -> str:
    if not isinstance(x, (list, tuple, np.ndarray)) and pd.isna(x):
        return "null"
    if isinstance(x, (float, np.floating)):
        return f"{x + 0.0:.9g}"
    if isinstance(x, (int, np.integer)) and not isinstance(x, bool):
        return f"{float(x):.9g}" if abs(x) < 1e6 else str(x)
    return str(x).removesuffix(" 00:00:00")


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].map(_value)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, expected: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} and {sorted(expected.columns)}"
    if len(got) != len(expected):
        return f"{len(got)} and {len(expected)} rows"
    a, b = canonical(got), canonical(expected)
    wrong = (a != b).any(axis=1)
    return "" if not wrong.any() else f"{wrong.sum()} rows differ:\n{a[wrong].head(3)}\n{b[wrong].head(3)}"
