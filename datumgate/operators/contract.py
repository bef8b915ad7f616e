"""The schema contract on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import UnsupportedDataType
from ..functions.types import canonical_name, unsupported_message

REPORT = "table string, position int, field string, data_type string, canonical boolean"


def contract_rows(name: str, schema: T.StructType) -> list[tuple]:
    rows = []
    for i, field in enumerate(schema.fields):
        known = canonical_name(field.dataType)
        rows.append((name, i, field.name, known or field.dataType.simpleString(), known is not None))
    return rows


def contract_report(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per field of each table; only schemas are looked at."""
    return spark.createDataFrame([r for n, df in tables.items() for r in contract_rows(n, df.schema)], REPORT)


def require_canonical(schema: T.StructType) -> None:
    """Raise on the first field the contract rejects."""
    for field in schema.fields:
        if canonical_name(field.dataType) is None:
            raise UnsupportedDataType(unsupported_message(field.name, field.dataType.simpleString()))
