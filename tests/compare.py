"""Compare a query with its DuckDB SQL on the same tables, order aside."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        at = f"{sf_dir}/{name}.parquet"
        at += "/*.parquet" if os.path.isdir(at) else ""
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}')")
    return db


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in found), key=repr)


def difference(spark, db, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    own = rows(df.columns, [tuple(r) for r in df.collect()])
    want = db.sql(sql)
    other = rows(want.columns, want.fetchall())
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    if own != other:
        first = next((x for x in zip(own, other) if x[0] != x[1]), None)
        return f"{len(own)} and {len(other)} rows; first difference {first}"
    return None
