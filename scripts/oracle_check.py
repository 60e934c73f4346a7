"""Run registered queries on Spark and their oracle SQL on DuckDB, then compare.

Usage: python scripts/oracle_check.py [--strict] [sf_dir] [name ...]
Compares column names, row counts and the multiset of rows (doubles compared after rounding
to 6 digits, or bit for bit with --strict).
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

import duckdb  # noqa: E402

from odflow.plans.queries import ORACLE, QUERIES  # noqa: E402
from odflow.session import get_spark  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


STRICT = "--strict" in sys.argv


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def main():
    args = [a for a in sys.argv[1:] if a != "--strict"]
    sf = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or sorted(QUERIES)
    spark = get_spark("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = QUERIES[n](spark, sf)
            scols = sdf.columns
            srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} SPARK-ERROR {str(e)[:300]}")
            continue
        ts = time.time() - t0
        if n not in ORACLE:
            print(f"{n:28s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(ORACLE[n])
            dcols = [d[0] for d in res.description]
            drows = [tuple(norm(x) for x in r) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} DUCK-ERROR {str(e)[:300]}")
            continue
        if sorted(scols) != sorted(dcols):
            print(f"{n:28s} COLS spark={scols} duck={dcols}")
            continue
        order = [dcols.index(c) for c in scols]
        drows = [tuple(r[i] for i in order) for r in drows]
        same = Counter(srows) == Counter(drows)
        ok += same
        print(f"{n:28s} {'OK  ' if same else 'DIFF'} spark={len(srows)} duck={len(drows)} {ts:.1f}s")
        if not same:
            a, b = Counter(srows) - Counter(drows), Counter(drows) - Counter(srows)
            print("   spark-only", list(a.items())[:3])
            print("   duck-only ", list(b.items())[:3])
    print(f"{ok}/{len(names)} match")


if __name__ == "__main__":
    main()
