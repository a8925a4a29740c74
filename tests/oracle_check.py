"""Run registered queries and their oracle SQL side by side.

Usage: ``python tests/oracle_check.py [sf_dir] [key ...]``.  Compares row
count, column names and the order-insensitive multiset of exact values.
Used by ``tests/test_oracle.py`` and by hand.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return ("null",)
    if v is pd.NA:  # a null of an integer column; pandas has NaN for it on the other side
        return ("nan",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", v)
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return ("f", float(v))
    return ("s", str(v))


def canon(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False)]
    rows.sort(key=repr)
    return cols, rows


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> dict:
    sc, sr = canon(spark_pdf)
    oc, orr = canon(oracle_pdf)
    out = {"rows_spark": len(sr), "rows_oracle": len(orr), "cols_match": sc == oc,
           "values_match": sc == oc and sr == orr}
    if sc != oc:
        out["cols"] = [sc, oc]
    elif sr != orr:
        diff = [(a, b) for a, b in zip(sr, orr) if a != b][:3]
        out["first_diffs"] = repr(diff)[:600]
    return out


def run(spark, sf_dir: str, keys: list[str] | None = None) -> dict:
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    res = {}
    for k in keys or list(qs):
        t0 = time.time()
        spdf = qs[k](spark, sf_dir).toPandas()
        t1 = time.time()
        if k not in sql:
            res[k] = {"rows_spark": len(spdf), "oracle": None, "spark_s": round(t1 - t0, 2)}
            continue
        opdf = con.execute(sql[k]).df()
        t2 = time.time()
        r = compare(spdf, opdf)
        r.update(spark_s=round(t1 - t0, 2), oracle_s=round(t2 - t1, 2))
        res[k] = r
    return res


if __name__ == "__main__":
    from quadrille.plans.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = local_session(8)
    print(json.dumps(run(spark, sf, keys), indent=1))
