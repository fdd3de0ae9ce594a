"""Spark query vs DuckDB oracle comparison (same rule as the driver's gate)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from moatlens.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, key: str, sf_dir: str, con=None):
    from moatlens.plans import ORACLES, QUERIES
    df = QUERIES[key](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    if key not in ORACLES:
        return {"key": key, "rows": len(s_rows), "oracle": None}
    con = con or duck(sf_dir)
    res = con.execute(ORACLES[key])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out = {"key": key, "rows": len(s_rows), "oracle_rows": len(d_rows),
           "cols_equal": sorted(s_cols) == sorted(d_cols),
           "distinct": {c: len({repr(_norm(x[i])) for x in s_rows}) for i, c in enumerate(s_cols)}}
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    out["equal"] = out["cols_equal"] and a == b
    if not out["equal"]:
        sa, sb = set(a), set(b)
        out["spark_only"] = list(sa - sb)[:3]
        out["oracle_only"] = list(sb - sa)[:3]
        out["spark_cols"] = sorted(s_cols)
        out["oracle_cols"] = sorted(d_cols)
    return out


if __name__ == "__main__":
    from moatlens.session import local_session
    from moatlens.plans import QUERIES
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    keys = sys.argv[1:] or sorted(QUERIES)
    spark = local_session(8)
    con = duck(sf)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, k, sf, con)
        except Exception as e:  # report and continue
            r = {"key": k, "error": repr(e)[:1500]}
        ok = r.get("equal", r.get("oracle", 1) is None and "error" not in r)
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print("bad", bad)
