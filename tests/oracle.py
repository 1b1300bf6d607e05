"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Mirrors the driver's gate: same row count, same column names, and the same
order-insensitive multiset of rows (values normalised to text).
"""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_norm(x)) for x in v) + "]"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def compare(spark_df, sql: str, con) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "cols_match": sorted(s_cols) == sorted(d_cols), "spark_cols": s_cols, "oracle_cols": d_cols}
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = {c: i for i, c in enumerate(d_cols)}
    s_ms = Counter(tuple(_norm(r[i]) for i in order) for r in s_rows)
    if out["cols_match"]:
        d_ms = Counter(tuple(_norm(r[d_index[s_cols[i]]]) for i in order) for r in d_rows)
    else:
        d_ms = Counter()
    out["values_match"] = out["cols_match"] and s_ms == d_ms
    if not out["values_match"] and out["cols_match"]:
        out["only_spark"] = list((s_ms - d_ms).elements())[:5]
        out["only_oracle"] = list((d_ms - s_ms).elements())[:5]
    out["ok"] = out["values_match"] and len(s_rows) == len(d_rows)
    return out
