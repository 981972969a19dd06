"""Holds a query's rows against DuckDB's."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    return columns, sorted(repr(tuple(map(_plain, r))) for r in found.select(*[f'"{c}"' for c in columns]).fetchall())


def _plain(x):
    return round(x, 6) if isinstance(x, float) else x


def check(df, sf_dir, sql):
    columns, expected = rows_of(sf_dir, sql)
    assert sorted(df.columns) == columns
    got = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    assert got == expected
