"""Side-by-side comparison of a registered query with its SQL in DuckDB.

Run as a script: ``python tests/compare.py sf0.01 [name ...]``.
"""

from __future__ import annotations

import collections
import datetime
import decimal
import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

DATA = os.environ.get("TARMAC_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else float(repr(v)))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def multiset(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir, queries, oracles):
    """(rows, problem or None)"""
    df = queries[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in oracles:
        return len(rows), None if rows else "no rows"
    cur = con.execute(oracles[name])
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return len(rows), f"columns {sorted(df.columns)} != {sorted(want_names)}"
    got_set, want_set = multiset(df.columns, rows), multiset(want_names, want)
    if got_set == want_set:
        return len(rows), None if rows else "no rows"
    extra, missing = got_set - want_set, want_set - got_set
    show = lambda c: [x for x, _ in sorted(c.items(), key=str)[:3]]
    return len(rows), f"{len(rows)} vs {len(want)} rows; {sum(extra.values())} extra {show(extra)}; {sum(missing.values())} missing {show(missing)}; columns {sorted(df.columns)}"


def main():
    from tarmac.queries import ORACLES, QUERIES
    from tarmac.session import local_session

    sf_dir = f"{DATA}/{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        begin = time.time()
        try:
            n, problem = compare(spark, con, name, sf_dir, QUERIES, ORACLES)
        except Exception as e:  # report and go on
            n, problem = -1, f"{type(e).__name__}: {str(e)[:900]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {kind} {n:8d} rows {time.time() - begin:6.1f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
