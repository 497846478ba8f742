"""Compare registered queries with their SQL: python tests/check_oracles.py [folder] [query ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def normalised(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return frame.sort_values(list(frame.columns), key=lambda c: c.map(repr)).reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} vs {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} vs {len(sql_rows)}"
    a, b = normalised(spark_rows), normalised(sql_rows)
    for column in a.columns:
        for x, y in zip(a[column], b[column]):
            if x != y and not (x is None and y is None):
                return f"column {column}: {x!r} vs {y!r}"
    kinds = [(c, type(x).__name__, type(y).__name__) for c in a.columns for x, y in [(a[c].iloc[0], b[c].iloc[0])]] if len(a) else []
    odd = [k for k in kinds if k[1] != k[2]]
    return f"types {odd}" if odd else None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, connection = session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, build in queries.items():
        if wanted and name not in wanted:
            continue
        try:
            start = time.time()
            rows = build(spark, folder).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows {name} {len(rows)} {took:.1f}s", flush=True)
                continue
            start = time.time()
            expected = connection.execute(oracles[name]).df()
            problem = difference(rows, expected)
            sql_took = time.time() - start
        except Exception as error:
            problem, took, sql_took, rows = f"{type(error).__name__}: {str(error)[:600]}", 0, 0, []
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {len(rows)} rows {took:.1f}s sql {sql_took:.1f}s {problem or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
