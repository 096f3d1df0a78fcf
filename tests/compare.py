"""Run queries against their SQL twins: python tests/compare.py [sf] [name-prefix ...]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, (int,)):
        return ("int", v)
    if isinstance(v, decimal.Decimal):
        return ("decimal", v)
    if isinstance(v, float):
        return ("float", float(f"{v:.9g}") + 0.0)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return ("time", str(v))
    return ("other", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, run, sql):
    started = time.time()
    df = run(spark, folder)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return len(got) > 0, f"rows={len(got)} (no SQL twin) {took:.1f}s"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    want = rows_of(names, cursor.fetchall())
    if got == want:
        return len(got) > 0, f"rows={len(got)} {took:.1f}s"
    extra = list(set(got) - set(want))[:3]
    missing = list(set(want) - set(got))[:3]
    return False, (f"rows {len(got)} vs {len(want)}; columns {sorted(names)}\n"
                   f"      spark only {extra}\n      sql only   {missing}")


def main(argv):
    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    from __spark_entry__ import oracle_sql, queries
    from legwise.session import local_session

    spark, con = local_session(8), connect(folder)
    sqls, bad = oracle_sql(), []
    chosen = [(n, q) for n, q in queries().items()
              if len(argv) < 2 or any(n.startswith(p) for p in argv[1:])]
    for name, run in chosen:
        try:
            good, note = compare(spark, con, folder, name, run, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        if not good:
            bad.append(name)
        print(("ok   " if good else "FAIL ") + name, note, flush=True)
    print(f"{len(chosen) - len(bad)}/{len(chosen)} ok; failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
