"""Compare a Spark result with an oracle result (row count, column names,
order-insensitive values). Used by tests and ``tools/check.py``."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from arrears.sources.adapters import BASES

DRIVER_TABLES = sorted({t for tables, _ in BASES.values() for t in tables})


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dt.time):
        return v.isoformat()
    return v


def rows_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_duck(con, query):
    rel = con.sql(query)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    return cols, [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]


def compare(df, con, query) -> dict:
    sc, sr = rows_spark(df)
    dc, dr = rows_duck(con, query)
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    sr.sort(key=key)
    dr.sort(key=key)
    out = {"rows_spark": len(sr), "rows_oracle": len(dr), "cols_match": sc == dc,
           "values_match": sr == dr}
    if sc != dc:
        out["cols"] = (sc, dc)
    elif sr != dr:
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        out["first_diff"] = diff
    out["ok"] = out["cols_match"] and out["values_match"]
    return out
