"""Run checked queries on Spark and DuckDB and compare the rows: ``python -m checks.compare SF_DIR [NAME…]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.spark import QUERIES
from checks.sql import ORACLE


def local_session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rankframe")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tables_in(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {file.stem} as from '{file}'")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(row[i] for i in places) for row in rows)


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> tuple[int, list]:
    """Number of rows, and up to three rows that are not the same on both sides."""
    df = QUERIES[name](spark, sf_dir)
    got = _rows(df.columns, [tuple(row) for row in df.collect()])
    if name not in ORACLE:
        return len(got), [("no SQL for", name)]
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(df.columns):
        return len(got), [("columns", df.columns, columns)]
    want = _rows(columns, result.fetchall())
    if len(got) != len(want):
        only = [r for r in got if r not in set(want)][:2] + [r for r in want if r not in set(got)][:2]
        return len(got), [("rows", len(got), len(want)), *only]
    return len(got), [(a, b) for a, b in zip(got, want) if a != b][:3]


def main(sf_dir: str, *names: str) -> int:
    spark, con = local_session(), tables_in(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            n, wrong = differences(spark, con, sf_dir, name)
        except Exception as error:
            n, wrong = -1, [str(error)[:1500]]
        bad += bool(wrong)
        print(f"{'DIFF' if wrong else 'ok  '} {name:26} {n:8} rows {time.time() - start:6.2f}s", flush=True)
        for item in wrong:
            print("     ", str(item)[:1500])
    return bad


if __name__ == "__main__":
    sys.exit(min(main(*sys.argv[1:]), 1))
