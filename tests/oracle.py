"""Run catalog queries beside their oracle text and compare whole results.

As a script: python tests/oracle.py FOLDER [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


TIMES: dict[str, list[float]] = {}  # seconds per query: Spark, then the oracle


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        return value.date()
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, name: str, query, text: str | None) -> str:
    """'' when equal, else what differs."""
    begin = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    TIMES[name] = [time.time() - begin]
    if text is None:
        return "" if got else "no rows"
    begin = time.time()
    relation = con.execute(text)
    names = [d[0] for d in relation.description]
    want = relation.fetchall()
    TIMES[name].append(time.time() - begin)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    left, right = rows_of(df.columns, got), rows_of(names, want)
    if left == right:
        return "" if got else "no rows"
    extra, lost = left - right, right - left
    return f"{len(got)} rows against {len(want)}; only here {sorted(extra, key=str)[:3]}; only oracle {sorted(lost, key=str)[:3]}"


if __name__ == "__main__":
    from ledgerloom.plans.catalog import ORACLES, QUERIES
    from ledgerloom.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(folder)
    for name in wanted or QUERIES:
        try:
            problem = compare(spark, con, folder, name, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # report and go on with the other queries
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {' '.join(f'{t:5.1f}s' for t in TIMES.get(name, []))} {name} {problem}", flush=True)
