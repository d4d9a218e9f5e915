"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def duck_rows(sql: str, folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(name, run, sql, spark, folder):
    """None when equal, else a short account of the difference."""
    frame = run(spark, folder)
    spark_names, spark_rows = frame.columns, [tuple(r) for r in frame.collect()]
    if sql is None:
        return None, len(spark_rows)
    names, rows = duck_rows(sql, folder)
    if sorted(names) != sorted(spark_names):
        return f"columns {sorted(spark_names)} vs {sorted(names)}", len(spark_rows)
    a, b = canonical(spark_names, spark_rows), canonical(names, rows)
    if a == b:
        return None, len(a)
    extra, missing = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
    return f"rows {len(a)} vs {len(b)}; spark-only {extra}; sql-only {missing}", len(a)


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tidegauge import all_queries, build_session, oracle_statements
    from tidegauge.session import drop_stages

    from tidegauge.operators import ordered

    ordered.PARTS = int(os.environ.get("PARTS", "0")) or None
    sf = os.environ.get("SF", "0.01")
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g", "spark.sql.warehouse.dir": "/tmp/warehouse",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = all_queries(), oracle_statements()
    chosen = [q for q in queries if not sys.argv[1:] or any(a in q for a in sys.argv[1:])]
    bad = 0
    for q in chosen:
        start = time.time()
        try:
            problem, n = compare(q, queries[q], oracles.get(q), spark, f"{ROOT}/sf{sf}")
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:700]}", -1
        drop_stages(spark)
        state = "ok " if problem is None else "BAD"
        bad += problem is not None
        kind = "sql" if q in oracles else "rows"
        print(f"{state} {q:28s} {kind:4s} n={n:<7d} {time.time() - start:6.2f}s", problem or "", flush=True)
    print("bad", bad, "of", len(chosen))
