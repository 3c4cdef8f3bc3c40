"""Run queries in Spark and their SQL twins in DuckDB and compare the rows.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terrakit.bindings import TABLES  # noqa: E402
from terrakit.registry import all_queries  # noqa: E402
from terrakit.session import build_session  # noqa: E402

ROOT = "/root/testdata"


def test_session():
    return build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.sql.session.timeZone": "UTC",
        },
    )


test_session.__test__ = False


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int,)):
        return float(value)
    if hasattr(value, "is_integer") or isinstance(value, float):
        value = float(value)
        return None if math.isnan(value) else (value + 0.0 or 0.0)
    if type(value).__name__ == "Decimal":
        return float(value)
    if type(value).__name__ in ("datetime", "Timestamp"):
        return str(value.replace(tzinfo=None))
    return value


def row_set(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, q, sf_dir: str):
    start = time.time()
    df = q(spark, sf_dir)
    got = row_set(df.columns, df.collect())
    took = time.time() - start
    if not q.sql:
        return ("rows", len(got), took, "")
    start = time.time()
    result = con.execute(q.sql)
    names = [d[0] for d in result.description]
    want = row_set(names, result.fetchall())
    duck = time.time() - start
    note = f"duckdb {duck:.1f}s"
    if sorted(names) != sorted(df.columns):
        return ("COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(names)}")
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return ("DIFF", len(got), took, f"want {len(want)} rows, e.g. {diff}")
    return ("ok" if got else "EMPTY", len(got), took, note)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"{ROOT}/sf{args.sf}"
    spark = test_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    bad = 0
    for name, q in sorted(all_queries().items()):
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            status, rows, took, note = compare(spark, con, q, sf_dir)
        except Exception as exc:
            status, rows, took, note = "ERROR", 0, 0.0, str(exc)[:1500]
        bad += status not in ("ok", "rows")
        print(f"{status:8} {name:34} {rows:8} {took:6.1f}s  {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
