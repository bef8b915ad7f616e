"""Profiles and quality checks of Parquet datasets from their footers.

Footers hold row counts, null counts and the bounds of integers. Spark answers
such aggregates without reading data pages when the aggregate pushdown of its
Parquet source is on. Null checks on any amount of data then cost one read of
the footers, and a profile scans only the columns whose bounds footers do not
hold exactly: floating point and text.
"""

from __future__ import annotations

from typing import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted, ref
from ..functions.local import local_frame
from ..functions.types import declared_name
from ..model import MinRowCount, QualityRule
from ..sources.scan import NANOS_AS_LONG, open_parquet, read_parquet
from .profile import column_states, profile_columns, with_percentage
from .quality import quality_violations, violations_of

PUSHDOWN = {
    "spark.sql.sources.useV1SourceList": "",
    "spark.sql.parquet.aggregatePushdown": "true",
    NANOS_AS_LONG: "true",
}

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Types without bounds in a profile, and types whose bounds need a scan.
UNBOUNDED = (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
SCANNED = (T.FloatType, T.DoubleType, T.StringType)


def _aggregates(fields: Sequence[T.StructField], bounds: bool) -> list[Column]:
    aggregates = ["count(*) AS rows"]
    for i, field in enumerate(fields):
        aggregates.append(f"count({quoted(field.name)}) AS present_{i}")
        if bounds and isinstance(field.dataType, INTEGERS):
            aggregates += [f"{side}({quoted(field.name)}) AS {side}_{i}" for side in ("min", "max")]
    return [F.expr(a) for a in aggregates]


def footer_query(
    spark: SparkSession, path: str, fields: Sequence[T.StructField], bounds: bool, partitioned: bool = False
) -> DataFrame:
    """Row count, counts per field and integer bounds as one row.

    A session of its own carries the settings, so the caller's stay as they are.
    """
    session = spark.newSession()
    for key, value in PUSHDOWN.items():
        session.conf.set(key, value)
    return read_parquet(session, path, partitioned).agg(*_aggregates(fields, bounds))


def _counts(df: DataFrame, path: str, fields: Sequence[T.StructField], bounds: bool, partitioned: bool) -> Row:
    """The row of ``footer_query``; scanned from ``df`` when a footer lacks statistics.

    Spark reports missing statistics as a failed read.
    """
    try:
        [row] = footer_query(df.sparkSession, path, fields, bounds, partitioned).collect()
    except (PySparkException, Py4JJavaError) as failure:
        if "spark.sql.parquet.aggregatePushdown" not in str(failure):
            raise
        [row] = df.agg(*_aggregates(fields, bounds)).collect()
    return row


def _states(like: DataFrame, row: Row, fields: Sequence[T.StructField], positions: dict[str, int]) -> DataFrame:
    """Column states, with the columns of ``like``, from one row of counts."""
    rows = []
    for i, field in enumerate(fields):
        state = dict.fromkeys(like.columns)
        state.update(
            position=positions[field.name],
            column=field.name,
            data_type=declared_name(field),
            total_count=row["rows"],
            null_count=row["rows"] - row[f"present_{i}"],
        )
        if f"min_{i}" in row:
            state.update(min_long=row[f"min_{i}"], max_long=row[f"max_{i}"])
        rows.append(tuple(state[c] for c in like.columns))
    return local_frame(like.sparkSession, rows, like.schema)


def profile_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``profile_columns``, with what footers hold taken from them.

    The footer pass runs at once, the scan of the other columns stays lazy.
    """
    df, partitioned = open_parquet(spark, path)
    positions = {f.name: i for i, f in enumerate(df.schema.fields)}
    stated = [f for f in df.schema.fields if isinstance(f.dataType, INTEGERS + UNBOUNDED)]
    if not stated:
        return profile_columns(df)
    row = _counts(df, path, stated, True, partitioned)
    scanned = df.drop(*[f.name for f in stated])
    read = column_states(scanned)
    states = _states(read, row, stated, positions)
    if scanned.columns:
        place = F.element_at(F.array(*[F.lit(positions[c]) for c in scanned.columns]), F.col("position") + 1)
        states = states.unionByName(read.withColumn("position", place))
    return with_percentage(states)


def quality_violations_parquet(spark: SparkSession, path: str, rules: Sequence[QualityRule]) -> DataFrame:
    """Violations of ``rules`` on a Parquet dataset, by its footers.

    Writers leave out the statistics of columns with very long texts, so text
    columns are asked for apart: they alone are scanned then. Rules on nested
    columns always lead to a scan.
    """
    df, partitioned = open_parquet(spark, path)
    named = {r.column for r in rules if not isinstance(r, MinRowCount)}
    fields = [f for f in df.schema.fields if f.name in named]
    if not all(isinstance(f.dataType, INTEGERS + UNBOUNDED + SCANNED) for f in fields):
        return quality_violations(df, rules)
    like = column_states(df.select(*[ref(f.name) for f in fields]), bounds=False, summary=True)
    positions = {f.name: i for i, f in enumerate(fields)}
    texts = [f for f in fields if isinstance(f.dataType, T.StringType)]
    others = [f for f in fields if f not in texts]
    row = _counts(df, path, others, False, partitioned)
    summary = dict.fromkeys(like.columns)
    summary.update(position=-1, total_count=row["rows"], null_count=0)
    whole = local_frame(spark, [tuple(summary.values())], like.schema).unionByName(_states(like, row, others, positions))
    if texts:
        whole = whole.unionByName(_states(like, _counts(df, path, texts, False, partitioned), texts, positions))
    return violations_of(with_percentage(whole), rules)
