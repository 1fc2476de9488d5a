"""Compare a Spark DataFrame with a DuckDB oracle query, the way the driver does:
row count, column names/types and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math
import os

import duckdb
import pandas as pd

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    return v


def frame_digest(pdf: pd.DataFrame) -> tuple[int, str]:
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append(repr(tuple(_norm(v) for v in rec)))
    rows.sort()
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(rows), h


def compare(spark_df, con, sql: str) -> dict:
    s = spark_df.toPandas()
    o = con.sql(sql).df()
    out = {
        "spark_rows": len(s),
        "oracle_rows": len(o),
        "spark_cols": sorted(s.columns),
        "oracle_cols": sorted(o.columns),
    }
    out["cols_match"] = out["spark_cols"] == out["oracle_cols"]
    if out["cols_match"]:
        out["hash_match"] = frame_digest(s) == frame_digest(o)
        if not out["hash_match"]:
            # first differing row, for debugging
            cols = sorted(s.columns)
            a = sorted(repr(tuple(_norm(v) for v in r)) for r in s[cols].itertuples(index=False, name=None))
            b = sorted(repr(tuple(_norm(v) for v in r)) for r in o[cols].itertuples(index=False, name=None))
            sa, sb = set(a), set(b)
            out["only_spark"] = [x for x in a if x not in sb][:3]
            out["only_oracle"] = [x for x in b if x not in sa][:3]
    else:
        out["hash_match"] = False
    return out
