"""Order-insensitive, column-name-sorted comparison of a Spark result with DuckDB SQL."""

import math
from collections import Counter
from datetime import date, datetime

import duckdb
from pyspark.sql import DataFrame

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _kind(value):
    return "number" if isinstance(value, (int, float)) else type(value).__name__


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def assert_same(spark_result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Exact equality, doubles included; returns the row count."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    assert sorted(spark_result.columns) == sorted(names)
    ours = _bag(spark_result.columns, spark_result.collect())
    theirs = _bag(names, expected.fetchall())
    missing, extra = theirs - ours, ours - theirs
    assert not missing and not extra, (
        f"{sorted(names)}: {sum(missing.values())} missing, {sum(extra.values())} extra; "
        f"e.g. expected {list(missing)[:2]} got {list(extra)[:2]}"
    )
    return sum(ours.values())
