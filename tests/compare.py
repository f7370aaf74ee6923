"""Spark results against DuckDB's, column by column and row by row, in any order."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if glob.glob(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype
        if kind.kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif kind.kind in "iufb" or str(kind) in ("Int64", "boolean"):
            df[c] = df[c].astype(object).where(df[c].notna(), None).map(lambda x: None if x is None else repr(float(x)))
        df[c] = df[c].astype(object).where(df[c].notna(), None).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql: str, con) -> str:
    want = con.execute(sql).fetchdf()
    if sorted(want.columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(want.columns)}"
    if len(want) != len(spark_df):
        return f"rows {len(spark_df)} and {len(want)}"
    a, b = normal(spark_df), normal(want)
    if a.equals(b):
        return ""
    bad = (a != b).any(axis=1)
    return f"{bad.sum()} rows differ:\n{a[bad].head(3).to_string()}\n{b[bad].head(3).to_string()}"
