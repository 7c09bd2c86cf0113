"""Runs queries against their SQL as the driver does: names, row count and order-free values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def differences(df, sql: str, c: duckdb.DuckDBPyConnection) -> list[str]:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns {df.columns} against {names}")
    if len(got) != len(want):
        out.append(f"{len(got)} rows against {len(want)}")
    if got != want:
        out += [f"{a} against {b}" for a, b in zip(got, want, strict=False) if a != b][:3]
    return out
