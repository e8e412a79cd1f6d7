"""Compare every registered query with its DuckDB oracle at one scale factor.

    python check.py [sf_dir] [key-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

from geoloom.fixtures import TABLES
from geoloom.registry import all_queries
from geoloom.session import local_session


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return "null" if v is None else str(v)


FAMILY = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "DATE": "date", "FLOAT": "float", "TIMESTAMP": "timestamp_ntz", "TINYINT": "tinyint", "SMALLINT": "smallint",
    "HUGEINT": "hugeint", "UBIGINT": "ubigint",
}


def compare(spark, con, q, folder):
    t0 = time.time()
    got = q.run(spark, folder)
    cols = sorted(got.columns)
    rows = [tuple(norm(v) for v in r) for r in got.select(*[f"`{c}`" for c in cols]).collect()]
    took = time.time() - t0
    if q.sql is None:
        return took, len(rows), "rows only"
    rel = con.execute(q.sql)
    names = [d[0] for d in rel.description]
    want_cols = sorted(names)
    if cols != want_cols:
        return took, len(rows), f"COLUMNS {cols} != {want_cols}"
    idx = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in idx) for r in rel.fetchall()]
    note = ""
    types = {n: str(t) for n, t in con.execute(
        f"SELECT column_name, column_type FROM (DESCRIBE {q.sql})").fetchall()} if True else {}
    diff = [f"{c}:{t}/{types[c]}" for c, t in got.dtypes
            if FAMILY.get(types[c].split("(")[0], types[c]) != t]
    if diff:
        note = " TYPES " + " ".join(diff)
    if len(rows) != len(want):
        return took, len(rows), f"ROWS {len(rows)} != {len(want)}" + note
    a, b = sorted(rows), sorted(want)
    if a != b:
        bad = next((x, y) for x, y in zip(a, b) if x != y)
        n = sum(x != y for x, y in zip(a, b))
        return took, len(rows), f"VALUES {n} differ, first {dict(zip(cols, zip(*bad)))}"[:1200] + note
    return took, len(rows), ("ok" if rows else "EMPTY") + note


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for key, q in all_queries().items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        try:
            took, n, note = compare(spark, con, q, folder)
        except Exception as e:  # report and go on
            took, n, note = 0.0, 0, f"ERROR {type(e).__name__}: {str(e)[:700]}"
        if note not in ("ok", "rows only"):
            bad += 1
        print(f"{key:38s} {took:6.2f}s {n:7d}  {note}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
