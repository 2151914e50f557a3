"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from workload.queries import ORACLES, QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return tuple(value) if isinstance(value, list) else value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str:
    """Empty when both agree, else a short description of the difference."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return ""
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        extra, lacking = got - want, want - got
        return f"{sum(got.values())} rows != {sum(want.values())}; extra {list(extra.items())[:3]}; lacking {list(lacking.items())[:3]}"
    return "" if got else "no rows"


if __name__ == "__main__":
    folder = sys.argv[1]
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    database = connect(folder)
    for key in sys.argv[2:] or QUERIES:
        started = time.time()
        try:
            result = compare(session, database, key, folder) or "ok"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{key}: {result} ({time.time() - started:.1f}s)", flush=True)
