"""DuckDB over the same Parquet tables, for tests."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sql, sf_dir):
    """(columns, rows) of a query over the tables of a folder."""
    con = duckdb.connect()
    for table in TABLES.split():
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def compare(df, sql, sf_dir):
    """Assert that a DataFrame and a DuckDB query give the same rows."""
    names, rows = duck(sql, sf_dir)
    order = sorted(names)
    assert order == sorted(df.columns)
    want = sorted(repr([r[names.index(c)] for c in order]) for r in rows)
    got = sorted(repr([r[c] for c in order]) for r in df.collect())
    assert got == want
