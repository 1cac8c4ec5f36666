"""Side-by-side run of a query and its reference SQL on the same parquet tables."""

from __future__ import annotations

import glob
import os
import time

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for rec in pdf.itertuples(index=False, name=None):
        row = []
        for v in rec:
            if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
                row.append("NULL")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                row.append(str(bool(v)))
            elif hasattr(v, "__float__") and not isinstance(v, str):
                row.append(repr(float(v)))
            else:
                row.append(str(v))
        rows.append(tuple(row))
    return sorted(rows)


def compare(spark, con, key: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    got = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    out = {"key": key, "spark_rows": len(got), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        return {**out, "ok": None}
    want = con.execute(sql).fetchdf()
    out["duck_s"] = round(time.time() - t1, 2)
    out["duck_rows"] = len(want)
    if sorted(got.columns) != sorted(want.columns):
        return {**out, "ok": False, "why": f"columns {sorted(got.columns)} vs {sorted(want.columns)}"}
    a, b = _norm(got), _norm(want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return {**out, "ok": False, "why": f"cols {sorted(got.columns)}\n  spark only {only_a}\n  duck only {only_b}"}
    return {**out, "ok": True}
