"""Run queries in Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    con.execute("SET TimeZone = 'UTC'")
    return con


def _plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, list | tuple):
        return tuple(_plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(_plain(r[k]) for k in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def difference(a, b) -> str:
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows; first {a[1][:2]} and {b[1][:2]}"
    for x, y in zip(a[1], b[1], strict=True):
        for c, u, v in zip(a[0], x, y, strict=True):
            same = u == v or isinstance(u, int | float) and isinstance(v, int | float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=2e-6)
            if not same:
                return f"{c}: {u!r} and {v!r} in {x} and {y}"
            if type(u) is not type(v) and u is not None and v is not None:
                return f"type of {c}: {type(u).__name__} and {type(v).__name__}"
    return ""
