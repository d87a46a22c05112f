"""Rows of a query against rows of its SQL in DuckDB."""

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return v if isinstance(v, str) else str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple(map(str, r)))


def compare(df, con, sql):
    """None if equal, else what differs."""
    cursor = con.execute(sql)
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    return next((f"{g} and {w}" for g, w in zip(got[1], want[1], strict=True) if g != w), None)
