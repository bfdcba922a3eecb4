"""Run registered queries next to their SQL: python -m tests.oracle [sf] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

from logquarry.plans.views import TABLES

DATA = "/root/testdata"


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def shape(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in places) for r in rows)


def spark_rows(spark, query, sf_dir):
    df = query(spark, sf_dir)
    return shape(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    return shape([d[0] for d in cursor.description], cursor.fetchall())


def main():
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"{DATA}/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    names = sys.argv[2:] or list(queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sql = oracle_sql()
    for name in names:
        start = time.time()
        try:
            got = spark_rows(spark, queries()[name], sf_dir)
        except Exception as error:
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name not in sql:
            print(f"rows {name} {len(got[1])} {took:.1f}s", flush=True)
            continue
        try:
            want = duck_rows(sql[name], sf_dir)
        except Exception as error:
            print(f"SQL  {name}: {str(error)[:1500]}", flush=True)
            continue
        if got == want:
            print(f"ok   {name} {len(got[1])} {took:.1f}s", flush=True)
        else:
            print(f"DIFF {name} columns {got[0]} / {want[0]} rows {len(got[1])} / {len(want[1])}")
            print("   only spark", [r for r in got[1] if r not in set(want[1])][:3])
            print("   only duck ", [r for r in want[1] if r not in set(got[1])][:3], flush=True)
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    main()
