"""Compare every registered query with its oracle SQL, as a developer's tool.

    python check_oracle.py [scale folder] [name ...]

BENCH_CPUS: local cores. CHECK_CONF: session settings to try, "key=value,key=value".
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from yardstats.plans.registry import load, runner
from yardstats.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, [tuple(_cell(row[c]) for c in columns) for row in df.collect()]


def oracle_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(_cell(r[i]) for i in order) for r in result.fetchall()]
    return [names[i] for i in order], rows


def key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), v) for v in row)


def compare(got, want, ordered: bool) -> str:
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    left, right = got[1], want[1]
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    if not ordered:
        left, right = sorted(left, key=key), sorted(right, key=key)
    for place, (a, b) in enumerate(zip(left, right)):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"row {place}: {a} / {b}"
    return ""


def main() -> int:
    base = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(load())
    extra = dict(pair.split("=", 1) for pair in os.environ.get("CHECK_CONF", "").split(",") if pair)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), **extra)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(base)
    bad = 0
    for name in names:
        q = load()[name]
        started = time.time()
        try:
            got = spark_rows(runner(name)(spark, base))
            took = time.time() - started
            fault = compare(got, oracle_rows(con, q.sql), q.ordered) if q.sql else "no oracle"
        except Exception as e:  # report and go on to the next query
            took, got, fault = time.time() - started, ([], []), f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(fault)
        print(f"{'FAIL' if fault else 'ok  '} {name:32s} {len(got[1]):8d} rows {took:6.2f}s {fault}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
