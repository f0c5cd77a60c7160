"""Holds a query against its SQL, as rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in found.fetchall())
    got = sorted(tuple(plain(row[c]) for c in sorted(names)) for row in df.collect())
    assert got == want
