"""Runs registered queries beside their SQL text and lists the rows that differ.

``python -m sherdline.plans.check --sf /root/testdata/sf0.01 [names...]``
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import time
from collections import Counter

from pyspark.sql import SparkSession

from ..session import local_session
from . import load_all
from .registry import REGISTRY, runner
from .views import TABLES


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, (int, float)):
        number = float(value)
        return "nan" if number != number else number + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def compare(spark: SparkSession, con, name: str, folder: str) -> dict:
    item = REGISTRY[name]
    start = time.time()
    frame = runner(item)(spark, folder)
    rows = frame.collect()
    result = {"name": name, "rows": len(rows), "spark_sec": round(time.time() - start, 2), "problem": None}
    if item.oracle is None:
        return result | {"checked": False}
    start = time.time()
    cursor = con.execute(item.oracle)
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    result |= {"checked": True, "sql_sec": round(time.time() - start, 2)}
    if sorted(columns) != sorted(frame.columns):
        result["problem"] = f"columns {sorted(frame.columns)} against {sorted(columns)}"
        return result
    ours, theirs = rows_of(frame.columns, rows), rows_of(columns, expected)
    if ours != theirs:
        only_ours, only_theirs = ours - theirs, theirs - ours
        result["problem"] = (
            f"{len(rows)} rows against {len(expected)}; {sum(only_ours.values())} only here, "
            f"{sum(only_theirs.values())} only in SQL\n  columns {sorted(columns)}\n"
            f"  here {sorted(only_ours, key=str)[:3]}\n  sql  {sorted(only_theirs, key=str)[:3]}"
        )
    return result


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    load_all()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    names = [n for n in REGISTRY if not args.names or any(n.startswith(a) for a in args.names)]
    bad = 0
    for name in names:
        try:
            result = compare(spark, con, name, args.sf)
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            result = {"name": name, "problem": f"{type(error).__name__}: {str(error)[:1500]}"}
        if result["problem"]:
            bad += 1
            print("FAIL", result["name"], result["problem"], flush=True)
        else:
            print("ok  ", {k: v for k, v in result.items() if k != "problem"}, flush=True)
    print(f"{len(names)} queries, {bad} failing")


if __name__ == "__main__":
    main()
