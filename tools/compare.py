"""Run registered queries beside their SQL check: `python tools/compare.py SF_DIR [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, bool):
        return x
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name, fn, statement, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if statement is None:
        return ("rows only" if got else "EMPTY"), len(got), took, ""
    rel = con.execute(statement)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return ("ok" if got else "EMPTY"), len(got), took, ""
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return "DIFF", len(got), took, f"{len(a)} vs {len(b)} rows; cols {sorted(cols)}; {diff}"


def main() -> int:
    from tidemark.plans import catalog
    from tidemark.session import build_session
    from tidemark.sources.stage import clear_stages

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", f"local[{os.environ.get('BENCH_CPUS', '8')}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or catalog.QUERIES:
        try:
            state, n, took, note = compare(spark, con, name, catalog.QUERIES[name], catalog.SQL.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            state, n, took, note = "ERROR", 0, 0.0, (str(e) if "-v" not in sys.argv else traceback.format_exc())[:700]
        clear_stages(spark)
        bad += state not in ("ok", "rows only")
        print(f"{state:10s} {name:28s} {n:8d} {took:6.2f}s {note}", flush=True)
    print("not ok:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
