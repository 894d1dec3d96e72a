"""Compare registered queries with their SQL on DuckDB: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if value != value else f"{round(value, 6) + 0.0:.6f}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def kind(value):
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    return type(value).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for file in os.listdir(folder):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}'")
    return con


def compare(spark, con, folder, build, sql):
    started = time.time()
    df = build(spark, folder)
    spark_rows = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    if sql is None:
        return "rows-only", len(spark_rows), spent, ""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    duck_rows = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return "COLUMNS", len(spark_rows), spent, f"{sorted(df.columns)} vs {sorted(names)}"
    left, right = rows_of(df.columns, spark_rows), rows_of(names, duck_rows)
    if left != right:
        a, b = set(left) - set(right), set(right) - set(left)
        return "DIFF", len(left), spent, f"{len(left)} vs {len(right)} rows\n   cols {sorted(names)}\n   spark {sorted(a)[:3]}\n   duck  {sorted(b)[:3]}"
    types = {}
    for pos, name in enumerate(df.columns):
        types[name] = {kind(r[pos]) for r in spark_rows[:2000] if r[pos] is not None}
    for pos, name in enumerate(names):
        other = {kind(r[pos]) for r in duck_rows[:2000] if r[pos] is not None}
        if other != types[name] and other and types[name]:
            return "TYPES", len(left), spent, f"{name}: {types[name]} vs {other}"
    return ("ok" if left else "EMPTY"), len(left), spent, ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = sys.argv[2:]
    spark, con = session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            status, count, spent, note = compare(spark, con, folder, queries[name], oracles.get(name))
        except Exception as error:  # keep going, report at the end
            status, count, spent, note = "ERROR", 0, 0.0, str(error)[:1500]
        bad += status not in ("ok", "rows-only")
        print(f"{status:10} {name:32} {count:8} rows {spent:6.2f}s {note}", flush=True)
    print(f"{bad} not ok of {len(names or queries)}")
