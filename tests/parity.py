"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if value is None:
        return "null"
    if hasattr(value, "as_tuple"):
        return repr(round(float(value), 9))
    if isinstance(value, int) and not isinstance(value, bool):
        return repr(value)
    return str(value)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_rows(frame):
    return normalized(frame.columns, [tuple(r) for r in frame.collect()])


def duck_rows(con, sql):
    result = con.sql(sql)
    return normalized(result.columns, result.fetchall())
