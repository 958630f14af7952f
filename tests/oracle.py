"""Compare registered queries with their SQL: rows, schema and values, order ignored.

Run ``python -m tests.oracle [sf] [name-part ...]`` for a report.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ROOT = "/root/testdata"


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f{v!r}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, (dt.datetime, dt.date)):
        return f"t{v}"
    return f"{type(v).__name__[0]}{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, fn, sql: str | None, sf: str):
    """(ok, message, row count)"""
    df = fn(spark, f"{ROOT}/{sf}")
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, "rows only", len(got)
    con = duck(sf)
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    gn, g = rows_of(df.columns, got)
    wn, w = rows_of(want_names, want)
    if gn != wn:
        return False, f"columns {gn} != {wn}", len(got)
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    sg, sw = set(g), set(w)
    if len(g) != len(w):
        return False, f"rows {len(g)} != {len(w)}; {[x for x in g if x not in sw][:2]} / {[x for x in w if x not in sg][:2]}", len(got)
    if bad:
        only_g = [x for x in g if x not in sw][:3]
        only_w = [x for x in w if x not in sg][:3]
        return False, f"{gn}: {len(bad)} differ; spark {str(only_g)[:600]} / sql {str(only_w)[:600]}", len(got)
    return True, "match", len(got)


def main(argv):
    import __spark_entry__ as entry
    from docloom.session import build_session

    sf = argv[0] if argv else "sf0.01"
    parts = argv[1:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sql = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            ok, msg, n = compare(spark, fn, sql.get(name), sf)
        except Exception as e:  # noqa: BLE001
            ok, msg, n = False, f"{type(e).__name__}: {str(e)[:900]}", -1
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n} {time.time() - t:.1f}s {msg}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
