"""Compare a Spark result with a DuckDB result, whatever the row order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

from datumgate.plans.tables import TABLES, path_of


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path_of(sf_dir, name)}')")
    return con


def _norm(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def rows_of_spark(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_norm(r[n]) for n in names) for r in df.collect())


def rows_of_duckdb(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in cursor.fetchall())


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when the results are equal, else what differs."""
    names, got = rows_of_spark(df)
    expected_names, expected = rows_of_duckdb(con, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if got == expected:
        return None
    surplus, missing = got - expected, expected - got
    return (
        f"{sum(got.values())} rows, expected {sum(expected.values())}; "
        f"surplus {list(surplus)[:2]}, missing {list(missing)[:2]}"
    )
