"""Holds a query's rows against DuckDB over the same Parquet files."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns: list[str], rows: list) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str:
    """Empty if columns and rows agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    there, want = rows_of(names, cursor.fetchall())
    here, have = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if here != there:
        return f"columns {here} and {there}"
    if have != want:
        return f"{sum(have.values())} and {sum(want.values())} rows; only here {list((have - want))[:3]}; only there {list((want - have))[:3]}"
    return ""
