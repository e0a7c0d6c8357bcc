"""Run registered queries beside their DuckDB oracle and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from clearcase.bindings import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f{v:.6g}"
    if isinstance(v, int):
        return f"i{v}"
    return f"{type(v).__name__}:{v}"


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    """Difference as text, or None when the two results are equal."""
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    got = normalized(df.columns, df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        return None, len(got)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = normalized(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(cols)}", len(got)
    if got != want:
        a, b = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"rows {len(got)}/{len(want)}\n   spark {str(a)[:1500]}\n   duck  {str(b)[:1500]}", len(got)
    return None, len(got)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from clearcase.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    chosen = [n for n in queries() if not sys.argv[1:] or any(a in n for a in sys.argv[1:])]
    bad = 0
    for n in chosen:
        t = time.time()
        try:
            diff, rows = compare(spark, con, n, sf)
        except Exception as e:  # noqa: BLE001
            diff, rows = f"{type(e).__name__}: {str(e)[:1200]}", -1
        bad += diff is not None
        mark = "BAD " if diff else ("ok  " if n in oracle_sql() else "rows")
        print(f"{mark} {n} rows={rows} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print(f"{len(chosen)} run, {bad} bad")
