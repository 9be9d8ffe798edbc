"""Run registered queries against their SQL twins.

    python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bindings.registry import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", value.normalize() if value else decimal.Decimal(0))
    if isinstance(value, float):
        return ("double", 0.0 if value == 0 else value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> list[str]:
    """Differences between the two engines, as texts."""
    frame = fn(spark, sf_dir)
    ours = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = _rows(names, result.fetchall())
    problems = []
    if sorted(frame.columns) != sorted(names):
        problems.append(f"columns {sorted(frame.columns)} / {sorted(names)}")
    if ours.total() != theirs.total():
        problems.append(f"rows {ours.total()} / {theirs.total()}")
    if ours.total() == 0:
        problems.append("no rows")
    if ours != theirs:
        left, right = ours - theirs, theirs - ours
        key = lambda r: str(r)
        problems.append(f"{left.total()} rows only ours: {sorted(left, key=key)[:2]}")
        problems.append(f"{right.total()} rows only theirs: {sorted(right, key=key)[:2]}")
    return problems


def main() -> int:
    from bindings.all import QUERIES, SQL
    from opslens.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            if name in SQL:
                problems = compare(spark, con, fn, SQL[name], sf_dir)
            else:
                problems = [] if fn(spark, sf_dir).count() else ["no rows"]
        except Exception as error:  # noqa: BLE001 - shown to the reader
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in SQL else "ok (rows only)")
        print(f"{mark:14} {name} {time.time() - started:.1f}s", flush=True)
        for text in problems:
            print("    ", text[:1600])
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
