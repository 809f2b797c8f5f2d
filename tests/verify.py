"""Compare registered queries with their SQL: python tests/verify.py [NAME ...] (SF=sf0.01)."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from tessera.session import local_session  # noqa: E402


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def main(names):
    sf = f"/root/testdata/{os.environ.get('SF', 'sf0.01')}"
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    sql, bad = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            df = build(spark, sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            t = time.time() - t
            if name not in sql:
                print(f"{name}: {len(got[1])} rows, {t:.1f} s")
                continue
            cur = con.execute(sql[name])
            want = rows_of([d[0] for d in cur.description], cur.fetchall())
            same = got == want
            if not same:
                bad += 1
                diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
                print(f"{name}: DIFFERS {len(got[1])} {len(want[1])} {got[0]} {want[0]} {diff}")
            else:
                print(f"{name}: ok {len(want[1])} rows, {t:.1f} s")
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: ERROR {str(e)[:900]}")
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
