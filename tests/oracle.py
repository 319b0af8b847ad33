"""Compares a query with its SQL on DuckDB."""

import glob

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        for path in glob.glob(f"{sf}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in found)


def same(spark, sf, query, sql):
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    con = connect(sf)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, found.fetchall())
