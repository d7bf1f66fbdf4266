"""Compares a query with its DuckDB SQL, as multisets of rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, (str, bool)):
        return value
    return round(float(value), 6)


def same(df, sf_dir, sql):
    want = connect(sf_dir).sql(sql)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    order = [want.columns.index(n) for n in names]
    left = sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=repr)
    right = sorted((tuple(plain(row[i]) for i in order) for row in want.fetchall()), key=repr)
    assert left == right
