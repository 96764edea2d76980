"""Run a registered Spark query and its DuckDB oracle, compare results.

Used by the test-suite and by hand:  python -m tests.compare [names...]
"""

from __future__ import annotations

import math
import sys

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, tol_digits=6):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, tol_digits - 1)
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> dict:
    import __spark_entry__ as entry
    q = entry.queries()[name]
    sql = entry.oracle_sql().get(name)
    sdf = q(spark, sf_dir)
    s_cols = sorted(sdf.columns)
    s_rows = [tuple(_norm(r[c]) for c in s_cols) for r in sdf.collect()]
    out = {"name": name, "spark_rows": len(s_rows)}
    if sql is None:
        out["oracle"] = None
        return out
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_raw = rel.fetchall()
    idx = {c: i for i, c in enumerate(d_cols)}
    out["duck_rows"] = len(d_raw)
    out["cols_match"] = sorted(d_cols) == s_cols
    if not out["cols_match"]:
        out["spark_cols"], out["duck_cols"] = s_cols, sorted(d_cols)
        return out
    d_rows = [tuple(_norm(r[idx[c]]) for c in s_cols) for r in d_raw]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    s_sorted, d_sorted = sorted(s_rows, key=key), sorted(d_rows, key=key)
    diffs = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b]
    out["mismatch"] = len(diffs) + abs(len(s_rows) - len(d_rows))
    if verbose and diffs:
        for a, b in diffs[:3]:
            print("  spark:", dict(zip(s_cols, a)))
            print("  duck :", dict(zip(s_cols, b)))
    return out


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from vigil.session import build_session
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    names = sys.argv[1:] or list(entry.queries())
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            res = compare(spark, n, sf, con)
        except Exception as e:  # noqa: BLE001
            res = {"name": n, "error": repr(e)[:400]}
        ok = res.get("oracle", 1) is None or (res.get("cols_match") and res.get("mismatch") == 0)
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(res), flush=True)
    print("failures:", bad)
