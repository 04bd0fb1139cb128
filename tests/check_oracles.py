"""Compare registered queries with their SQL counterparts: python tests/check_oracles.py [sf] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null" if v is None else "nan"
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return repr(f + 0.0) if math.isfinite(f) else str(f)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows), [names[i] for i in order]


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, fn, sql, sf_dir):
    """None if both sides agree, else a short description of the difference."""
    df = fn(spark, sf_dir)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} / {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def main():
    from __spark_entry__ import oracle_sql, queries
    from cohortlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        fn, sql = queries()[name], oracle_sql().get(name)
        start = time.time()
        try:
            if sql is None:
                result, note = None, f"rows only: {fn(spark, sf_dir).count()}"
            else:
                result, note = compare(spark, con, fn, sql, sf_dir), "same"
        except Exception as e:
            result, note = f"{type(e).__name__}: {str(e)[:600]}", ""
        failed += result is not None
        print(f"{'FAIL' if result else 'ok'} {name} {time.time() - start:.1f}s {result or note}", flush=True)
    print(f"{failed} failed of {len(names)}")


if __name__ == "__main__":
    main()
