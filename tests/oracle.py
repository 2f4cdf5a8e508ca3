"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def database(sf: str):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def same(spark, db, query, sql: str, sf: str) -> None:
    df = query(spark, sf)
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())
    assert len(got) == len(want)
    assert got == want
