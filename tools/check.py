"""Runs registered queries against their oracle: ``python tools/check.py [sf] [name or prefix ...]``."""

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from planloom.plans import load_all
from planloom.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (list, dict, tuple)):
        return str(v)
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return ("DECIMAL", v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


def compare(name, df, con, sql):
    rows = [tuple(norm(v) for v in r) for r in df.select(*sorted(df.columns)).collect()]
    t1 = time.time()
    rel = con.sql(sql)
    cols = rel.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(rows)
    want = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
    compare.sql_seconds = time.time() - t1
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}", len(rows)
    rows.sort(key=key)
    want.sort(key=key)
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        return f"{len(bad)} differ, e.g. {bad[0]}", len(rows)
    return None, len(rows)


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    reg = load_all()
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    names = [n for n in reg.QUERIES if not args or any(n.startswith(a) or reg.QUERIES[n].__module__ == a for a in args)]
    failed = 0
    for n in names:
        t0 = time.time()
        try:
            df = reg.QUERIES[n](spark, f"/root/testdata/{sf}")
            if n in reg.ORACLES:
                err, k = compare(n, df, con, reg.ORACLES[n])
            else:
                err, k = None, df.count()
                n += " (no oracle)"
        except Exception as e:  # noqa: BLE001
            err, k = f"{type(e).__name__}: {str(e)[:700]}", -1
        failed += err is not None
        print(f"{'FAIL' if err else 'ok  '} {n:34s} {k:8d} rows {time.time() - t0:6.1f}s (sql {getattr(compare, 'sql_seconds', 0):.1f}) {err or ''}", flush=True)
    print(f"{len(names) - failed} ok, {failed} failed")


if __name__ == "__main__":
    main()
