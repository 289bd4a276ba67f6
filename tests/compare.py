"""Rows of a Spark result and of DuckDB SQL in one comparable form."""

import glob
import math
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def same(df, con, sql):
    found = con.sql(sql)
    theirs = rows_of(found.columns, found.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(found.columns)
    assert ours == theirs
