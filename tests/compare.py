"""Run a query and its SQL text side by side; used by the tests and while developing."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, fn, sql):
    """(equal, message)."""
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{len(a)} vs {len(b)} rows; first differences (spark, sql): {diff}"
    return True, f"{len(a)} rows equal"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from limpid.session import local_session

    folder, only = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, folder, fn, sql.get(name))
        except Exception as e:  # shown, and the next query runs
            ok, message = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, f"{time.time() - start:.1f}s", message, flush=True)
    print("failed:", bad)
