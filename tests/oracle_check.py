"""Run registered queries beside their SQL oracle in DuckDB and compare the rows.

    python -m tests.oracle_check [folder] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str:
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    want = rows_of(ocols, cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(ocols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(ocols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} of {len(got)} differ, e.g.\n     spark {bad[0][0]}\n     sql   {bad[0][1]}\n     cols {sorted(ocols)}"
    return f"ok rows={len(got)}"


def main(argv) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from shiftgrain.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), E.oracle_sql(), 0
    for name, fn in E.queries().items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                res = compare(df, con, sqls[name])
            else:
                res = f"ok (rows only) rows={df.count()}"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            res = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += not res.startswith("ok")
        print(f"{'   ' if res.startswith('ok') else '!! '}{name:36s} {time.time() - t:6.1f}s {res}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
