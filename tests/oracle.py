"""Side-by-side run of a registered query and its SQL on the same parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from goodsledger.plans import catalogue
from goodsledger.plans.standins import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return repr({k: plain(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return repr([plain(v) for v in value])
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str):
    started = time.time()
    df = catalogue.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - started
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return None, len(got), spark_s, ""
    started = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    sql_s = time.time() - started
    note = ""
    if sorted(columns) != sorted(df.columns):
        note = f"columns {sorted(df.columns)} != {sorted(columns)}"
    elif got != want:
        a, b = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
        names = sorted(columns)
        odd = [(n, x, y) for n, x, y in zip(names, a[0], b[0]) if x != y] if a and b else ""
        note = f"{len(got)} vs {len(want)} rows, {len(a)}/{len(b)} differ: {odd}; spark only {a[:1]}; sql only {b[:1]}"
    return note == "", len(got), spark_s, note or f"sql {sql_s:.1f}s"


if __name__ == "__main__":
    from goodsledger.session import local_session

    sf = sys.argv[1]
    folder = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(catalogue.queries())
    session = local_session(8)
    con = duck(folder)
    bad = []
    for n in names:
        try:
            ok, count, seconds, note = compare(session, con, n, folder)
        except Exception as exc:  # keep going, report at the end
            ok, count, seconds, note = False, -1, 0.0, f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{'ok ' if ok else '-- ' if ok is None else 'BAD'} {n:34s} {count:8d} rows {seconds:6.2f}s {note}", flush=True)
        if ok is False:
            bad.append(n)
    print("BAD:", bad)
