"""DataFrames from a few rows the driver holds."""

from __future__ import annotations

from typing import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Rows as a local relation, whose size the optimizer knows."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [()] * len(struct.names)
    table = pa.table([pa.array(list(c)) for c in columns], names=struct.names)
    return spark.createDataFrame(table, schema=struct)
