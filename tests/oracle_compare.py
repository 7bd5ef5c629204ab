"""Run registered queries on Spark and their SQL twins on DuckDB and compare.

Usage: python -m tests.oracle_compare [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
import time

import duckdb

from structura.plans.registry import all_queries
from structura.sources.tables import TABLES


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
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
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (_dt.date, _dt.datetime)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, sf_dir: str, key: str, con=None, verbose: bool = True) -> dict:
    q = all_queries()[key]
    t0 = time.time()
    sdf = q.fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    t1 = time.time()
    res = {"key": key, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if q.sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck_connection(sf_dir)
    rel = con.sql(q.sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    res["duck_rows"] = len(d_rows)
    s_types = [f.dataType.simpleString() for f in sdf.schema.fields]
    res["cols_match"] = sorted(s_cols) == sorted(d_cols)
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    res["values_match"] = a == b
    res["status"] = "ok" if res["cols_match"] and res["values_match"] else "MISMATCH"
    if verbose and res["status"] != "ok":
        print(key, "spark cols", list(zip(s_cols, s_types)))
        print(key, "duck  cols", list(zip(d_cols, d_types)))
        sa, sb = set(a), set(b)
        print(key, "only spark:", list(sa - sb)[:3])
        print(key, "only duck :", list(sb - sa)[:3])
    res["types"] = {c: (s, d) for c, s in zip(s_cols, s_types)
                    for c2, d in zip(d_cols, d_types) if c == c2}
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    keys = [k for k in argv[1:] if not os.path.isdir(k)] or sorted(all_queries())
    from structura.session import local_session
    spark = local_session()
    con = duck_connection(sf_dir)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, sf_dir, k, con)
        except Exception as e:  # report and go on
            r = {"key": k, "status": "ERROR", "error": repr(e)[:400]}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        r.pop("types", None)
        print(r, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
