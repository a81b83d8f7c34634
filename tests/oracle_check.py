"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# KINFOLD_EXACT=1 compares doubles bit for bit (no rounding).
EXACT = bool(os.environ.get("KINFOLD_EXACT"))
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    import datetime
    import decimal
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, status="rows-only", n=len(srows), sec=round(t1 - t0, 2))
    res = con.sql(sql)
    dcols = res.columns
    drows = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return dict(name=name, status="SCHEMA", spark=scols, duck=dcols)
    if len(srows) != len(drows):
        return dict(name=name, status="ROWCOUNT", spark=len(srows), duck=len(drows))
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return dict(name=name, status="VALUES", n_bad=len(bad), first=bad[:3], cols=sorted(scols))
    return dict(name=name, status="ok", n=len(srows), sec=round(t1 - t0, 2))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    from kinfold.session import build_session
    import __spark_entry__ as E
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    n_ok = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            r = compare(spark, con, name, fn, os_.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = dict(name=name, status="ERROR", err=str(e)[:600])
        n_ok += r["status"] in ("ok", "rows-only")
        print(r, flush=True)
    print("OK", n_ok, "of", sum(1 for n in qs if not pats or any(p in n for p in pats)))


if __name__ == "__main__":
    main()
