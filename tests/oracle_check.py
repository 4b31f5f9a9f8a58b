"""Run registered queries against their DuckDB oracle (like the driver does).

Usage: python tests/oracle_check.py [sf_dir] [query ...]

Compares row count, sorted column names, and an order-insensitive hash of
the values (columns sorted by name, rows sorted by their text form).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "__float__") and not isinstance(v, (int, bool)):
        return repr(round(float(v), 6))
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]
    return [columns[i] for i in order], h, lines


def main() -> int:
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if a != sf_dir] or list(e.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("TM_SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.session.timeZone", os.environ.get("TM_TZ", "UTC"))
        .config("spark.sql.ansi.enabled", os.environ.get("TM_ANSI", "true"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql(f"SET TimeZone='{os.environ.get('TM_DUCK_TZ', 'UTC')}'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, oracle = e.queries(), e.oracle_sql()
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"{name:28s} SPARK ERROR {str(exc).splitlines()[0][:200]}")
            bad += 1
            continue
        secs = time.time() - t0
        if name not in oracle:
            print(f"{name:28s} rows={len(rows):7d} (no oracle) {secs:.1f}s")
            continue
        res = con.sql(oracle[name])
        ocols, orows = res.columns, [tuple(r) for r in res.fetchall()]
        sc, sh, sl = digest(cols, rows)
        oc, oh, ol = digest(ocols, orows)
        ok = len(rows) == len(orows) and sc == oc and sh == oh
        bad += not ok
        print(f"{name:28s} {'OK ' if ok else 'BAD'} rows={len(rows)}/{len(orows)} {secs:.1f}s")
        if not ok:
            if sc != oc:
                print("   cols spark ", sc, "\n   cols oracle", oc)
            diff_s = sorted(set(sl) - set(ol))[:3]
            diff_o = sorted(set(ol) - set(sl))[:3]
            for d in diff_s:
                print("   spark only :", d[:300])
            for d in diff_o:
                print("   oracle only:", d[:300])
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
