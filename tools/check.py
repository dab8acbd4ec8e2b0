"""Run driver queries on Spark and their SQL twins on DuckDB and compare.

    python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from driver_queries import REGISTRY, SQL  # noqa: E402
from folioscan.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def normal(value):
    if value is None or (isinstance(value, float) and pd.isna(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{round(float(value), 6):.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + "|".join(normal(v) for v in value) + "]"
    return str(value)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    names = [n for n in REGISTRY if not args.names or any(n.startswith(a) for a in args.names)]
    for name in names:
        t0 = time.time()
        try:
            df = REGISTRY[name](spark, sf_dir)
            cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            if name not in SQL:
                print(f"rows  {name}: {len(got)} rows, {t1 - t0:.1f}s", flush=True)
                continue
            cur = con.execute(SQL[name])
            wcols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
            ok = cols == wcols and got == want
            print(f"{'ok  ' if ok else 'DIFF'}  {name}: {len(got)}/{len(want)} rows, "
                  f"spark {t1 - t0:.1f}s, duckdb {time.time() - t1:.1f}s", flush=True)
            if not ok:
                bad += 1
                print("   columns", cols, wcols)
                gs, ws = set(got), set(want)
                print("   only spark ", sorted(gs - ws)[:4], len(gs - ws))
                print("   only duckdb", sorted(ws - gs)[:4], len(ws - gs))
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {str(exc)[:900]}", flush=True)
        finally:
            spark.catalog.clearCache()
    return bad


if __name__ == "__main__":
    sys.exit(main())
