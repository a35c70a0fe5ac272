"""Rows of a query against DuckDB's rows of its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    if x is not None and not isinstance(x, (str, bool)):
        try:
            return round(float(x), 9)
        except (TypeError, ValueError):
            return str(x)
    return x


def rows(names, found):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in at) for r in found), key=repr)


def compare(spark, sf, query, sql):
    df = query(spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.sql(sql)
    names = list(got.columns)
    assert set(names) <= set(df.columns), (names, df.columns)
    mine = rows(names, [tuple(r) for r in df.select(*names).collect()])
    theirs = rows(names, got.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-8) for x, y in zip(a, b)), (a, b)
