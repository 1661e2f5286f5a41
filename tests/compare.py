"""Run registered queries next to their SQL in DuckDB and compare row multisets.

    python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def row_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def differences(spark, con, fn, sql, sf_dir):
    """None when equal, else a short description."""
    df = fn(spark, sf_dir)
    got_cols, got = row_set(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = row_set([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not got:
        return "empty"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        types = [t for _, t in df.dtypes]
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]} {types}"
    if repr(got) != repr(want):
        first = next((a, b) for a, b in zip(got, want) if repr(a) != repr(b))
        return f"types differ: {first}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from conftest import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = tuple(argv[1:])
    spark = make_session()
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sorted(queries):
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = differences(spark, con, queries[name], oracles[name], sf_dir)
            else:
                rows = queries[name](spark, sf_dir).collect()
                problem = None if rows else "no rows"
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        mark = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {mark} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
