"""Compare registered queries with their SQL: ``python -m tests.oracle_check [--sf DIR] [name ...]``."""

from __future__ import annotations

import argparse
import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, float(v))
    return (3, str(v))


def _same(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def compare(spark_df, con, sql):
    """None if equal, else a short text. Also tells values that only agree within rounding."""
    names = sorted(spark_df.columns)
    result = con.execute(sql)
    oracle_names = sorted(d[0] for d in result.description)
    if names != oracle_names:
        return f"columns differ: {sorted(set(names) ^ set(oracle_names))}"
    order = [[d[0] for d in result.description].index(n) for n in names]
    want = [tuple(r[i] for i in order) for r in result.fetchall()]
    got = [tuple(r[n] for n in names) for r in spark_df.select(*names).collect()]
    if len(got) != len(want):
        return f"{len(got)} rows, oracle has {len(want)}"
    firm = [i for i, n in enumerate(names) if not any(isinstance(r[i], float) for r in want[:50])]
    loose = [i for i in range(len(names)) if i not in firm]
    order_by = lambda r: ([_key(r[i]) for i in firm], [_key(r[i]) for i in loose])
    got.sort(key=order_by)
    want.sort(key=order_by)
    near = 0
    for g, w in zip(got, want, strict=True):
        for n, a, b in zip(names, g, w, strict=True):
            if not _same(a, b):
                return f"{n}: {a!r} against {b!r} in {dict(zip(names, g, strict=True))}"
            near += a != b
    kinds = [(n, type(a).__name__, type(b).__name__) for g, w in list(zip(got, want, strict=True))[:20] for n, a, b in zip(names, g, w, strict=True) if a is not None and type(a) is not type(b)]
    if kinds:
        return f"types differ: {sorted(set(kinds))}"
    return f"{near} values only near" if near else None


def main():
    from __spark_entry__ import oracle_sql, queries
    from aerolith import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(args.sf), oracle_sql(), 0
    for name, run in queries().items():
        if args.names and name not in args.names:
            continue
        begin = time.time()
        try:
            df = run(spark, args.sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                note = f"rows only: {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            note = f"FAIL {type(e).__name__}: {str(e)[:600]}"
        bad += note.startswith(("DIFF", "FAIL"))
        print(f"{time.time() - begin:6.1f}s {name:34s} {note}", flush=True)
    print(f"{bad} problems", flush=True)


if __name__ == "__main__":
    main()
