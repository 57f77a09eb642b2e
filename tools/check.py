"""Run registered queries beside their SQL and report differences.

    python tools/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ectolog.session import local_session  # noqa: E402
from ectolog.workload import ORACLES, QUERIES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple(map(str, r)))


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return f"rows-only {len(got[1])}"
    cur = con.execute(ORACLES[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"FAIL columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"FAIL rows {len(got[1])} != {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    if bad:
        return f"FAIL {len(bad)} of {len(got[1])} rows, e.g. {bad[0]}"
    return f"ok {len(got[1])}"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in args or QUERIES:
        start = time.time()
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            result = f"FAIL {type(error).__name__}: {str(error)[:600]}"
        failed += result.startswith("FAIL")
        print(f"{name:28s} {time.time() - start:6.2f}s {result}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
