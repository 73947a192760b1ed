"""Run a query in Spark and its SQL in DuckDB and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=repr), [names[i] for i in order]


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want, want_names = _sorted(rel.fetchall(), names)
    got, got_names = _sorted([tuple(r) for r in df.collect()], df.columns)
    if want_names != got_names:
        return f"columns differ: spark {got_names} sql {want_names}", len(got)
    if len(want) != len(got):
        return f"row counts differ: spark {len(got)} sql {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first spark {bad[0][0]} sql {bad[0][1]} of {want_names}", len(got)
    return None, len(got)
