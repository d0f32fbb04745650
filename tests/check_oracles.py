"""Run registered queries against their SQL: ``python tests/check_oracles.py [sf] [name...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return repr(v)
        if isinstance(v, (int,)):
            return repr(v)
        if hasattr(v, "__float__"):
            f = float(v)
            return repr(int(f)) if f == int(f) and math.isfinite(f) else f"{f:.9g}"
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(con, spark, name, fn, oracle, sf_dir):
    started = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if oracle is None:
        return True, f"{len(rows)} rows, no SQL", took
    cur = con.execute(oracle)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(df.columns)} != {sorted(want_cols)}", took
    a, b = canonical(rows, df.columns), canonical(want, want_cols)
    if a != b:
        left = [x for x in a if x not in set(b)][:3]
        right = [x for x in b if x not in set(a)][:3]
        return False, f"{len(a)} vs {len(b)} rows\n   spark {left}\n   sql   {right}", took
    return True, f"{len(rows)} rows", took


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = argv[1] if len(argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            ok, note, took = compare(con, spark, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:1200]}", 0
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.1f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv)
