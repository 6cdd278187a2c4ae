"""Run registered queries next to their SQL twins: python tests/oracle_check.py [--sf DIR] [name-prefix ...]"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("terrapath")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~nan" if v != v else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark, con, query, sql, sf):
    t0 = time.time()
    df = query(spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return "rows-only", len(rows), t1 - t0, 0.0, "" if rows else "EMPTY"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return "SCHEMA", len(rows), t1 - t0, 0.0, f"{cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    other = [tuple(r[i] for i in idx) for r in cur.fetchall()]
    t2 = time.time()
    a = sorted(tuple(norm(v) for v in r) for r in rows)
    b = sorted(tuple(norm(v) for v in r) for r in other)
    if a == b:
        return "ok" if rows else "EMPTY", len(rows), t1 - t0, t2 - t1, ""
    sa, sb = set(a) - set(b), set(b) - set(a)
    return "DIFF", len(rows), t1 - t0, t2 - t1, (
        f"{cols}\n   spark rows {len(a)} sql rows {len(b)} differing {len(sa)}/{len(sb)}\n   spark {sorted(sa)[:2]}\n   sql   {sorted(sb)[:2]}"
    )


def main(argv):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark, con = session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, q in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            status, n, ts, td, info = compare(spark, con, q, oracles.get(name), sf)
        except Exception as e:  # report and go on
            status, n, ts, td, info = "ERROR", 0, 0, 0, str(e)[:700]
        print(f"{status:9s} {name:34s} rows={n:7d} spark={ts:6.2f}s sql={td:6.2f}s {info}", flush=True)
        if status not in ("ok", "rows-only") or info:
            bad.append(name)
    print("BAD:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
