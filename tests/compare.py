"""Run registered queries next to their SQL twins and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, int):
        return f"{v:.6g}" if abs(v) >= 10**6 else str(v)
    return str(v)


def exact(v):
    if isinstance(v, float) and not math.isnan(v):
        return repr(round(v, 9))
    return str(v)


def rows_of(columns, rows, fmt):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(fmt(r[i]) for i in order) for r in rows)


def compare(spark, con, name, plan, sql, sf_dir):
    """(verdict, rows, seconds, detail) of one query."""
    start = time.time()
    df = plan(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return ("rows" if got else "EMPTY"), len(got), took, ""
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got, exact), rows_of(cols, want, exact)
    if a == b:
        kinds = {c: {type(v).__name__ for r in got for c2, v in zip(df.columns, r) if c2 == c} for c in df.columns}
        other = {c: {type(v).__name__ for r in want for c2, v in zip(cols, r) if c2 == c} for c in cols}
        odd = {c: (kinds[c], other[c]) for c in kinds if kinds[c] - {"NoneType"} != other[c] - {"NoneType"}}
        return ("same" if got else "EMPTY"), len(got), took, str(odd or "")
    left, right = set(a), set(b)
    extra = [r for r in a if r not in right][:3]
    lack = [r for r in b if r not in left][:3]
    return "DIFFERENT", len(got), took, f"{len(a)} vs {len(b)} rows; only Spark {extra}; only SQL {lack}"


def main() -> None:
    from codeloom.plans import all_queries
    from codeloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for name, q in all_queries().items():
        if names and not any(n in name for n in names):
            continue
        try:
            verdict, n, took, detail = compare(spark, con, name, q.plan, q.sql, sf_dir)
        except Exception as e:  # report and go on with the next query
            verdict, n, took, detail = "ERROR", 0, 0.0, str(e)[:1500]
        bad += verdict not in ("same", "rows")
        print(f"{verdict:10} {name:32} {n:7} rows {took:6.2f}s {detail}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
