"""Runs a query and its SQL on the same tables and compares the rows."""

import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def compare(spark, folder: str, query, sql: str) -> None:
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    found = connect(folder).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert rows == wanted
