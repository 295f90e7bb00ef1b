"""Side-by-side check of the registered queries against DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, int):
        return v
    if hasattr(v, "as_integer_ratio"):
        return round(float(v), 6)
    return str(v)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [columns[i] for i in order], out


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return (True, f"rows-only {len(got)} rows {t1 - t0:.1f}s")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    exp_cols, exp = rows_of(cols, cur.fetchall())
    t2 = time.time()
    if got_cols != exp_cols:
        return (False, f"columns {got_cols} vs {exp_cols}")
    if got != exp:
        a, b = set(got), set(exp)
        return (
            False,
            f"rows {len(got)} vs {len(exp)}; only spark {list(a - b)[:2]}; only duck {list(b - a)[:2]}"
            f" ({len(a - b)}/{len(b - a)})",
        )
    return (True, f"{len(got)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s")


def main():
    import __spark_entry__ as entry
    from bitextra.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            ok, msg = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as exc:  # noqa: BLE001 - report every failing query
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, msg, flush=True)
    print("failed", bad)


if __name__ == "__main__":
    main()
