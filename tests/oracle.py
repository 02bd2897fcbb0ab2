"""Side-by-side comparison of a Spark result with its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    out = {}
    for name in frame.columns:
        col = frame[name]
        if pd.api.types.is_float_dtype(col):
            out[name] = col.astype(float)
        elif pd.api.types.is_integer_dtype(col) or pd.api.types.is_bool_dtype(col):
            out[name] = col.astype(float)
        else:
            out[name] = col.map(lambda v: "<null>" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v))
    out = pd.DataFrame(out)
    return out.sort_values(list(out.columns), na_position="first", ignore_index=True) if len(out.columns) else out


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    def kind(col):
        if pd.api.types.is_bool_dtype(col):
            return "bool"
        if pd.api.types.is_integer_dtype(col):
            return "int"
        if pd.api.types.is_float_dtype(col):
            return "float"
        return "text"

    return {c: kind(frame[c]) for c in sorted(frame.columns)}


def mismatch(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when both hold the same rows exactly, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} rows != {len(sql_frame)}"
    left, right = _plain(spark_frame), _plain(sql_frame)
    for name in left.columns:
        a, b = left[name], right[name]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = int(np.flatnonzero(~same)[0])
            return f"{(~same).sum()} of {len(a)} differ in {name}:\n{left.iloc[at].to_dict()}\n{right.iloc[at].to_dict()}"
    return None


def type_difference(spark_df, con, sql: str) -> str | None:
    same = {"bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER"}
    ours = {f.name: same.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema.fields}
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    off = {c: (ours[c], theirs.get(c)) for c in ours if ours[c] != theirs.get(c)}
    return str(off) if off else None
