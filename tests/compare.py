"""Rows of a query against those of its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def key(row):
    return tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else str(round(v, 5) + 0.0 if isinstance(v, float) else v) for v in row)


def assert_same(df, sql, folder):
    result = connect(folder).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(key([r[names.index(n)] for n in order]) for r in result.fetchall())
    got = sorted(key([r[n] for n in order]) for r in df.collect())
    assert got == want
