"""Spark-vs-DuckDB comparison used by the tests and by ``tools``-style runs.

Mirrors the driver's gate: row count, column names, order-insensitive values.
Floats are compared exactly and, separately, within a relative 1e-9, so that
last-bit differences show up without failing on them silently.
"""

from __future__ import annotations

import datetime as dt
import math

import duckdb

from skylane.sources.fixtures import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, repr(v)) if isinstance(v, float) else (2, str(v)) for v in row)


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in records]


def _close(a, b, rel=1e-9):
    if a is None or b is None:
        return a is b
    if isinstance(a, bool) or isinstance(b, bool):
        return bool(a) == bool(b) and type(a) is type(b)
    if isinstance(a, float) or isinstance(b, float):
        if not isinstance(a, (int, float)) or not isinstance(b, (int, float)):
            return False
        return abs(a - b) <= rel * max(1.0, abs(a), abs(b))
    return a == b


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
                 "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def compare(spark_df, sql: str, con) -> dict:
    s_cols = spark_df.columns
    s_types = dict(spark_df.dtypes)
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    o_cols = [d[0] for d in rel.description]
    o_rows = rel.fetchall()
    o_types = {c: str(t) for c, t in zip(con.sql(sql).columns, con.sql(sql).types)}
    type_diff = [(c, s_types[c], o_types.get(c)) for c in s_cols
                 if SPARK_TO_DUCK.get(s_types[c], s_types[c]) != o_types.get(c)]
    sc, sr = rows_of(s_cols, s_rows)
    oc, orr = rows_of(o_cols, o_rows)
    out = {"spark_rows": len(sr), "oracle_rows": len(orr), "spark_cols": sc, "oracle_cols": oc,
           "names_match": sc == oc, "rows_match": len(sr) == len(orr), "types_match": not type_diff}
    if type_diff:
        out["type_diff"] = type_diff
    if not out["names_match"] or not out["rows_match"]:
        out.update(exact=False, approx=False)
        return out
    sr.sort(key=_key)
    orr.sort(key=_key)
    out["exact"] = sr == orr
    approx = all(len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b)) for a, b in zip(sr, orr))
    if not approx:
        # retry with an order that tolerates float noise in sort keys
        def k2(row):
            return tuple((0, "") if v is None else (1, f"{v:.6e}") if isinstance(v, float) else (2, str(v)) for v in row)
        sr.sort(key=k2)
        orr.sort(key=k2)
        approx = all(all(_close(x, y) for x, y in zip(a, b)) for a, b in zip(sr, orr))
    out["approx"] = approx
    if not approx:
        for a, b in zip(sr, orr):
            if not all(_close(x, y) for x, y in zip(a, b)):
                out["first_diff"] = {"spark": a, "oracle": b}
                break
    return out
