"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tools/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from ledgerloom.session import local_session  # noqa: E402
from registry import all_queries, all_sql  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session("compare", 8)
    sql = all_sql()
    bad = 0
    for name, fn in all_queries().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: spark {type(e).__name__}: {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - start
        got = bag(df.columns, rows)
        if name not in sql:
            print(f"rows {name}: {len(rows)} rows, {took:.1f}s (no SQL)", flush=True)
            continue
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        start = time.time()
        try:
            cur = con.execute(sql[name])
            want = bag([d[0] for d in cur.description], cur.fetchall())
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: sql {str(e)[:1500]}", flush=True)
            continue
        ok = got == want
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(rows)} rows, spark {took:.1f}s, sql {time.time() - start:.1f}s", flush=True)
        if not ok:
            bad += 1
            print("   columns", got[0], want[0])
            print("   spark only:", list((got[1] - want[1]).items())[:3])
            print("   sql only:  ", list((want[1] - got[1]).items())[:3])
    print("differences:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
