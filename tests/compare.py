"""Compares a Spark result with DuckDB SQL over the same tables, as sorted rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def oracle(sql: str, sf: str = "sf0.01"):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(DATA, sf).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*' if p.is_dir() else ''}'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bytearray | bytes):
        return bytes(v).hex()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, sf: str = "sf0.01"):
    want = rows_of(*oracle(sql, sf))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0], (got[0], want[0])
    diff = [x for x in zip(got[1], want[1]) if x[0] != x[1]]
    assert len(got[1]) == len(want[1]) and not diff, (len(got[1]), len(want[1]), len(diff), diff[:3])
    return len(got[1])
