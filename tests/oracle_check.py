"""Run registered queries next to their check SQL and compare all rows.

    python -m tests.oracle_check [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


# how column types of the two engines correspond
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(float(f"{value:.10g}") + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in records)


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return True, f"rows only: {len(mine[1])}", took
    t = time.time()
    result = con.execute(sql)
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    took = (round(took, 2), round(time.time() - t, 2))
    kinds = {d[0]: str(d[1]) for d in result.description}
    odd = [f"{c}:{k}/{kinds.get(c)}" for c, k in df.dtypes if kinds.get(c) != SAME_TYPE.get(k, k)]
    if odd:
        print("types", name, *odd)
    if mine[0] != theirs[0]:
        return False, f"columns {mine[0]} vs {theirs[0]}", took
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return False, f"{len(mine[1])} vs {len(theirs[1])} rows; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}", took
    return True, f"{len(mine[1])} rows", took


def main():
    import __spark_entry__ as entry
    from annospark.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark, con = local_session(), connect(args.sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name in args.names or queries:
        try:
            ok, note, took = compare(spark, con, name, queries[name], sql.get(name), args.sf)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note, took = False, f"{type(error).__name__}: {str(error)[:600]}", None
        print("ok  " if ok else "FAIL", name, note, took, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
