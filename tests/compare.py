"""Compare registered queries with their check SQL in DuckDB.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, repr(float(value)))
    return (3, str(value))


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, con, sf: str, name: str, query, sql: str) -> str | None:
    """None when both sides agree, otherwise a short description."""
    frame = query(spark, sf)
    got = frame.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not want:
        return "no rows on either side"
    left, right = table(frame.columns, got), table(names, want)
    for a, b in zip(left, right, strict=True):
        if a != b:
            return f"{sum(x != y for x, y in zip(left, right))} rows differ, first: {str(a)[:300]} != {str(b)[:300]}"
    return None


def main() -> int:
    from pricetrace.catalog import ORACLES, QUERIES
    from pricetrace.session import local_session

    sf, chosen = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf)
    failed = 0
    for name, query in QUERIES.items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = differences(spark, con, sf, name, query, ORACLES[name])
            else:
                problem = None if query(spark, sf).collect() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
