"""Run registered queries and their SQL side by side on the given tables."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """(problem or None, rows, seconds)."""
    t = time.time()
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - t
    if sql is None:
        return None, len(got), seconds
    rel = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got), seconds
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got), seconds
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}", len(got), seconds
    return None, len(got), seconds


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tallyclerk.session import session

    sf_dir, wanted = sys.argv[1], set(sys.argv[2:])
    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    for name, q in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            problem, n, s = compare(spark, con, name, q, entry.oracle_sql().get(name), sf_dir)
        except Exception as err:
            problem, n, s = f"{type(err).__name__}: {str(err)[:700]}", 0, 0
        bad += problem is not None
        print(f"@{name:28} {n:>8} {s:7.2f}s {'ok' if problem is None else 'BAD ' + problem[:900]}", flush=True)
    print("@bad", bad)
