"""Compares a Spark result with DuckDB's for the same tables, without regard to order."""

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.sql(sql).fetch_arrow_table().to_pandas()


def canonical(x: pd.DataFrame) -> pd.DataFrame:
    x = x[sorted(x.columns)].copy()
    for c in x.columns:
        if x[c].dtype.kind == "f":
            x[c] = x[c].round(6)
        x[c] = x[c].map(lambda v: "∅" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) and v % 1 else str(int(v)) if isinstance(v, float | bool) or hasattr(v, "dtype") and v.dtype.kind in "biuf" and v % 1 == 0 else str(v))
    return x.sort_values(list(x.columns)).reset_index(drop=True)


def differences(df, sf_dir: str, sql: str) -> str:
    """Empty when both sides hold the same rows and column names."""
    mine, other = df.toPandas(), duck(sf_dir, sql)
    if sorted(mine.columns) != sorted(other.columns):
        return f"columns {sorted(mine.columns)} != {sorted(other.columns)}"
    a, b = canonical(mine), canonical(other)
    if a.equals(b):
        return ""
    extra = a.merge(b, how="outer", indicator=True).query("_merge != 'both'")
    return f"{len(a)} and {len(b)} rows, {len(extra)} differ: {extra.head(4).to_dict('records')}"
