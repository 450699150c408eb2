"""Run registered queries next to their SQL: python tests/check_oracles.py [sf] [name ...]."""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from stillgood.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [
        tuple(None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA else v for v in row)
        for row in df.astype(object).itertuples(index=False)
    ]
    return sorted(rows, key=repr)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {str(bad[0])[:600]}" if bad else ""


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark, con = build_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in oracles:
                want = con.execute(oracles[name]).df()
                problem = compare(got, want)
                kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got if c in want and got[c].dtype != want[c].dtype}
                status = f"FAIL {problem}" if problem else f"ok {kinds or ''}"
            else:
                status = "rows only"
        except Exception as error:  # report and go on
            took, got, status = time.time() - start, [], f"ERROR {str(error)[:1500]}"
        failed += status.startswith(("FAIL", "ERROR"))
        print(f"{name:24s} {took:6.2f}s {len(got):7d} {status}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
