"""Compare registered queries with their oracle on one data folder.

python tests/check_oracles.py [sf] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, (date, datetime)):
        return str(v)[:10]
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(spark, con, build, sql, folder):
    t = time.time()
    df = build(spark, folder)
    got = df.collect()
    spent = time.time() - t
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(cols):
        return spent, len(got), f"columns {set(df.columns) ^ set(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return spent, len(a), f"rows {len(a)} vs {len(b)}"
    names = sorted(cols)
    for x, y in zip(a, b):
        bad = [n for n, u, v in zip(names, x, y) if not close(u, v)]
        if bad:
            return spent, len(a), f"{bad}: {x} vs {y}"
    return spent, len(a), "ok"


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    want = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = e.oracle_sql()
    bad = 0
    for name, build in e.queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        try:
            if name in oracles:
                spent, n, verdict = compare(spark, con, build, oracles[name], folder)
            else:
                t = time.time()
                n = build(spark, folder).count()
                spent, verdict = time.time() - t, "no oracle"
        except Exception as ex:  # noqa: BLE001
            spent, n, verdict = 0, 0, f"{type(ex).__name__}: {str(ex)[:1500]}"
        bad += verdict not in ("ok", "no oracle")
        print(f"{name:45s} {n:7d} {spent:6.2f}s {verdict[:1600]}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
