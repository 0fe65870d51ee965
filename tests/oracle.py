"""Runs registered queries against DuckDB on the driver's tables.

``python tests/oracle.py [sf] [name…]`` prints one line per mismatch.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
    "FLOAT": "float",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL" if value is None else "nan"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None if both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    have = {n: k for n, k in df.dtypes}
    mine = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {n: KINDS.get(str(d[1]), str(d[1])) for n, d in zip(names, result.description)}
    theirs = result.fetchall()
    if sorted(have) != sorted(names):
        return f"columns {sorted(have)} vs {sorted(names)}"
    off = {n: (have[n], kinds[n]) for n in have if have[n] != kinds[n]}
    order = sorted(names)
    a = sorted(tuple(cell(row[n]) for n in order) for row in mine)
    at = [names.index(n) for n in order]
    b = sorted(tuple(cell(row[i]) for i in at) for row in theirs)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if a != b:
        gaps = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(gaps)}/{len(a)} rows differ in {order}, e.g. {gaps[0]}"
    if off:
        return f"types {off}"
    if not a:
        return "no rows"
    return None


def main() -> None:
    from plumbline.plans import catalog
    from plumbline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:]
    names = [n for n in catalog.QUERIES if not wanted or any(w == n or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    spark = local_session()
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in catalog.ORACLE:
                issue = compare(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], sf_dir)
            else:
                n = len(catalog.QUERIES[name](spark, sf_dir).collect())
                issue = None if n else "no rows"
        except Exception as error:
            issue = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - start
        mark = "ok " if issue is None else "BAD"
        bad += issue is not None
        kind = "" if name in catalog.ORACLE else " (rows only)"
        print(f"{mark} {took:6.2f}s {name}{kind} {issue or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree", flush=True)


if __name__ == "__main__":
    main()
