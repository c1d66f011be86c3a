"""Run registered queries beside their SQL in DuckDB and compare all rows.

    python tools/check_queries.py [folder] [name ...]

"""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from permaway.plans import ORACLES, QUERIES
from permaway.session import build_session


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def same(a, b, slack):
    if isinstance(a, float) and isinstance(b, (float, int)) or isinstance(b, float) and isinstance(a, int):
        return a == b or (math.isnan(a) and math.isnan(b)) or (slack and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6))
    return a == b


def compare(spark, db, name, folder):
    began = time.time()
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - began
    if name not in ORACLES:
        return f"rows only {len(got)}", spent
    found = db.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    a_cols, a = rows_of(df.columns, got)
    b_cols, b = rows_of(columns, found.fetchall())
    if a_cols != b_cols:
        return f"COLUMNS {a_cols} {b_cols}", spent
    if len(a) != len(b):
        return f"ROWS {len(a)} {len(b)}", spent
    if not a:
        return "EMPTY", spent
    off = [(x, y) for x, y in zip(a, b) if not all(same(p, q, False) for p, q in zip(x, y))]
    if off:
        far = [(x, y) for x, y in off if not all(same(p, q, True) for p, q in zip(x, y))]
        return f"{'VALUES' if far else 'rounding'} {len(off)}/{len(a)} {(far or off)[0]}", spent
    types = {(c, type(p).__name__, type(q).__name__) for x, y in zip(a[:50], b[:50]) for c, p, q in zip(a_cols, x, y) if type(p) is not type(q) and None not in (p, q)}
    return f"ok {len(a)}" + (f" types {sorted(types)}" if types else ""), spent


def main():
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session("check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    bad = 0
    for name in args or QUERIES:
        try:
            verdict, spent = compare(spark, db, name, folder)
        except Exception as error:
            verdict, spent = f"FAILED {type(error).__name__} {str(error)[:600]}", 0.0
        bad += not verdict.startswith(("ok", "rows"))
        print(f"{name:28s} {spent:6.2f}s {verdict}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
