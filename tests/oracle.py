"""Compare a query's rows with its DuckDB oracle: names, kinds of types, and values in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def differences(df, con, sql: str) -> str:
    """Empty if both agree."""
    rel = con.sql(sql)
    names, kinds = list(rel.columns), [str(t) for t in rel.types]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    types = dict(df.dtypes)
    wrong = [f"{c}: {types[c]} and {k}" for c, k in zip(names, kinds, strict=True) if KINDS.get(types[c], types[c]) != k]
    order = sorted(names)
    ours = sorted((tuple(_cell(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(_cell(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    if wrong:
        return f"types {wrong}"
    if ours != theirs:
        first = next(((a, b) for a, b in zip(ours, theirs, strict=False) if a != b), None)
        return f"{len(ours)} and {len(theirs)} rows; first difference {str(first)[:1500]}"
    return ""
