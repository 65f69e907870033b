"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key and a summary; exit code 1 on any mismatch.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.10g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def key_of(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    cols = sdf.columns
    srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return "rows-only", len(srows), None, t1 - t0
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [tuple(norm(x) for x in r) for r in res.fetchall()]
    if sorted(cols) != sorted(dcols):
        return f"COLUMNS spark={cols} duck={dcols}", len(srows), len(drows), t1 - t0
    order = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in order) for r in drows]
    if len(srows) != len(drows):
        return "ROWCOUNT", len(srows), len(drows), t1 - t0
    a, b = sorted(srows, key=key_of), sorted(drows, key=key_of)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"VALUES {len(bad)} differ, e.g. {bad[0]}", len(srows), len(drows), t1 - t0
    return "ok", len(srows), len(drows), t1 - t0


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not a.startswith("/")]
    from envmon.session import get_session
    import __spark_entry__ as E
    conf = {}
    if os.environ.get("NO_BROADCAST"):  # run the large-table paths: no hinted or automatic broadcasts
        conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    if os.environ.get("PLAIN_SESSION"):  # the driver's own session: defaults, another time zone
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.sql.session.timeZone", "America/Los_Angeles")
                 .getOrCreate())
    else:
        spark = get_session("local[8]", shuffle_partitions=8, conf=conf)
    spark.sparkContext.setLogLevel("ERROR")
    qs, ors = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    fails = 0
    for k in (keys or list(qs)):
        try:
            status, ns, nd, sec = compare(spark, con, k, qs[k], ors.get(k), sf_dir)
        except Exception as e:  # report and go on
            status, ns, nd, sec = f"ERROR {type(e).__name__}: {str(e)[:300]}", None, None, 0
        if status not in ("ok", "rows-only"):
            fails += 1
        print(f"{k:40s} {status:10s} spark={ns} duck={nd} {sec:.2f}s", flush=True)
    print(f"SUMMARY keys={len(keys or qs)} fails={fails}")
    return 1 if fails else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
