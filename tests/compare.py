"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() else round(value, 6)
    if hasattr(value, "as_tuple"):
        return plain(float(value))
    return value


def rows_of(names, records):
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(plain(record[i]) for i in order) for record in records]
    return sorted(names), sorted(rows, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(row) for row in df.collect()])


def sql_rows(con, sql):
    result = con.sql(sql)
    return rows_of(result.columns, result.fetchall())
