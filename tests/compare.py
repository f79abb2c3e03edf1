"""Runs a catalog query and its SQL twin over the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{files}'")
    return con


def key(row: tuple) -> tuple:
    return tuple((v is not None, "nan" if isinstance(v, float) and math.isnan(v) else v) for v in row)


def rows_of_both(spark, query, sql: str, sf_dir: str, con=None):
    df = query(spark, sf_dir)
    con = con or connect(sf_dir)
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols, (sorted(rel.columns), cols)
    mine = sorted((key(tuple(r[c] for c in cols)) for r in df.collect()), key=repr)
    theirs = sorted((key(r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
    return mine, theirs
