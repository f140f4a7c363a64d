"""Holds every query that has SQL against DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that find nothing on the smallest tables.
MAY_BE_EMPTY = {"by_day"}


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(sql)
    a = rows_of([d[0] for d in want.description], want.fetchall())
    df = query(spark, folder)
    b = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if not a[1] and name not in MAY_BE_EMPTY:
        return f"{name}: no rows to compare"
    if a[0] != b[0]:
        return f"{name}: columns {a[0]} {b[0]}"
    if a[1] != b[1]:
        only = [x for x in b[1] if x not in set(a[1])][:3], [x for x in a[1] if x not in set(b[1])][:3]
        return f"{name}: {len(b[1])} rows against {len(a[1])}; only here {only[0]}, only there {only[1]}"
    return None
