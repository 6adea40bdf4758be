"""Runs a query and its SQL on the same tables and compares the rows."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def check(df, sql, sf):
    c = duck(sf).execute(sql)
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, c.fetchall())
