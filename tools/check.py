"""Run named queries here and their SQL in DuckDB, and compare the rows.

    python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from revtide.catalog import QUERIES  # noqa: E402
from revtide.oracles import ORACLES  # noqa: E402
from revtide.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET lambda_syntax = 'ENABLE_SINGLE_ARROW'")  # as the SQL writes lambdas
    for f in sorted(os.listdir(sf_dir)):
        name = f.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)) if v is None else "", f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1.01e-4)
    return a == b


def compare(name: str, spark, con, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    t1 = time.time()
    if name not in ORACLES:
        return False, f"{len(got)} rows, no SQL, {t1 - t0:.1f}s"
    rel = con.sql(ORACLES[name])
    if sorted(rel.columns) != cols:
        return False, f"columns {cols} vs {sorted(rel.columns)}"
    names = ", ".join('"' + c + '"' for c in cols)
    want = con.sql(f"SELECT {names} FROM ({ORACLES[name]})").fetchall()
    t2 = time.time()
    note = f"{len(got)} vs {len(want)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if len(got) != len(want):
        return False, note
    exact = 0
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return False, f"{note}: {a} vs {b}"
        exact += a == b
    return True, note + ("" if exact == len(got) else f" ({len(got) - exact} rows differ in the last place)")


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in args.names or list(QUERIES):
        try:
            ok, note = compare(name, spark, con, sf_dir)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
