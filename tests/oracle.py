"""Side-by-side check of a registered Spark query against its DuckDB oracle.

Mirrors the correctness gate: same row count, same column names, and the same
multiset of rows after sorting columns by name (floats compared after rounding
to ``digits`` decimals).
"""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits)
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return v


def _key(row):
    return tuple((x is None, "" if x is None else str(type(x).__name__), x if x is not None else 0) for x in row)


def compare(spark, name: str, builder, sql: str, sf_dir: str, con=None, digits: int = 9):
    con = con or duck(sf_dir)
    sdf = builder(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out = {"query": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "cols_match": sorted(s_cols) == sorted(d_cols)}
    if not out["cols_match"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols
        out["match"] = False
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = {c: i for i, c in enumerate(d_cols)}
    s_norm = sorted((tuple(_norm(r[i], digits) for i in order) for r in s_rows), key=_key)
    d_norm = sorted((tuple(_norm(r[d_index[s_cols[i]]], digits) for i in order) for r in d_rows), key=_key)
    out["match"] = s_norm == d_norm
    if not out["match"]:
        diffs = [(a, b) for a, b in zip(s_norm, d_norm) if a != b][:3]
        out["first_diffs"] = diffs
        out["sorted_cols"] = [s_cols[i] for i in order]
    return out
