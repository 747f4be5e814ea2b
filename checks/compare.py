"""Run registered queries next to their DuckDB twins and compare the rows.

    python -m checks.compare [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from .registry import ORACLE, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def spark_session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def normal(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def difference(spark, con, sf_dir: str, name: str) -> tuple[str, int]:
    """('' if equal, else what differs; number of rows)."""
    df = QUERIES[name](spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        return "no twin", len(mine)
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {set(columns) ^ set(df.columns)}", len(mine)
    a, b = normal(df.columns, mine), normal(columns, theirs)
    if a == b:
        return "", len(mine)
    extra, missing = list((a - b).items())[:2], list((b - a).items())[:2]
    return (
        f"rows {len(mine)} / {len(theirs)}; {sorted(columns)}\n  only Spark {extra}"
        f"\n  only twin {missing}", len(mine),
    )


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = spark_session(), duck(sf_dir), 0
    for name in args or QUERIES:
        started = time.time()
        try:
            text, rows = difference(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the other queries
            text, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += bool(text)
        print(f"{'ok  ' if not text else 'FAIL'} {name} {rows} {time.time() - started:.1f}s {text}",
              flush=True)
    print(f"{bad} of {len(args or QUERIES)} differ")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
