"""Compares a query with its SQL in DuckDB on the given tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ")[:19]
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(sql, sf=SF):
    found = connect(sf).sql(sql)
    columns = found.columns
    names = sorted(columns)
    return names, sorted((tuple(plain(r[columns.index(n)]) for n in names) for r in found.fetchall()), key=repr)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1.01e-4 + 1e-9 * abs(a)
    return a == b


def assert_same(df, sql, sf=SF):
    (names, got), (wanted_names, wanted) = rows_of_spark(df), rows_of_sql(sql, sf)
    assert names == wanted_names
    assert len(got) == len(wanted)
    assert all(close(a, b) for x, y in zip(got, wanted, strict=True) for a, b in zip(x, y, strict=True))
