"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows.

Usage: python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import signal
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def make_session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("tripleloom-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.extraJavaOptions", "-Xss16m")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def typed(rows):
    return Counter(tuple((type(v).__name__, v) for v in map(plain, r)) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    took = time.time() - start
    if sql is None:
        return ("rows" if got else "EMPTY"), len(got), took, ""
    mid = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return "COLUMNS", len(got), took, f"spark {cols} duck {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in res.fetchall()]
    if time.time() - mid > 5:
        print(f"   (oracle side of {name}: {time.time() - mid:.1f}s)")
    a, b = typed(got), typed(want)
    if a == b:
        return ("ok" if got else "EMPTY"), len(got), took, ""
    only_a, only_b = list((a - b).items()), list((b - a).items())
    note = f"{cols}\n   rows spark {len(got)} duck {len(want)}; spark only {str(only_a[:3])[:700]}\n   duck only {str(only_b[:3])[:700]}"
    return "DIFF", len(got), took, note


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--slow", type=float, default=8.0)
    ap.add_argument("names", nargs="*")
    ap.add_argument("--limit", type=int, default=60, help="seconds per query")
    args = ap.parse_args()

    def late(*_):
        raise TimeoutError("took too long")
    signal.signal(signal.SIGALRM, late)
    import __spark_entry__ as entry
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = make_session(), duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    counts, took_all = Counter(), time.time()
    for name, fn in queries.items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        signal.alarm(args.limit)
        try:
            state, n, took, note = compare(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as err:  # report and go on with the next query
            spark.sparkContext.cancelAllJobs()
            text = str(err) or traceback.format_exc()
            state, n, took, note = "ERROR", 0, 0.0, text[:1200]
        signal.alarm(0)
        counts[state] += 1
        if state not in ("ok", "rows") or took > args.slow or len(args.names) > 0:
            print(f"{state:8}{name:28}{n:9} rows {took:6.1f}s {note}", flush=True)
    print(dict(counts), f"{time.time() - took_all:.0f}s")


if __name__ == "__main__":
    main()
