"""Ordered expressions over groups, or whole tables, of any size.

A plain window puts all rows of a group into one task. Here the rows in order are cut
into chunks by position: a range shuffle of the order columns alone deals them into
parts of equal size, whatever the values, and the first value of each part is a border.
The borders are all that reaches the driver, one for each ``width`` rows. The chunk of a row
follows from its own values by binary search, so a task that runs again finds the same
chunk. Windows run per chunk, and what crosses a border is carried by one row
per chunk.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of a chunk.
CHUNK = 100_000


@dataclass(frozen=True)
class Borders:
    """The first values of all chunks but the first, in order, and their type."""

    values: list[tuple]
    kind: T.StructType


def borders_of(df: DataFrame, order: Sequence[str], chunks: int) -> Borders:
    """Borders of about ``chunks`` chunks of equal size; rows equal in ``order`` are never parted.

    ``order`` names integer or text columns without nulls.
    """
    asked = df.select(*order)
    if chunks < 2:
        return Borders([], asked.schema)
    parts = asked.repartitionByRange(chunks, *order)
    firsts = parts.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*order)).alias("first"))
    return Borders(sorted({tuple(r.first) for r in firsts.select("first").toLocalIterator()})[1:], asked.schema)


def chunk_of(order: Sequence[Column], borders: Borders) -> Column:
    """The number of borders up to a row's values, by binary search."""
    values = borders.values
    if not values:
        return F.lit(0)
    # One literal, however many borders.
    rows = json.dumps([dict(zip(borders.kind.names, v, strict=True)) for v in values], ensure_ascii=False)
    known = F.from_json(F.lit(rows), T.ArrayType(borders.kind))
    own = F.struct(*[c.alias(n) for c, n in zip(order, borders.kind.names, strict=True)])
    steps, step = [], 1 << (len(values).bit_length() - 1)
    while step:
        steps.append(F.lit(step))
        step //= 2

    def search(reached: Column, step: Column) -> Column:
        further = reached + step
        # The place before ``further`` counts from 0; beyond the last border there is none.
        return F.when((further <= len(values)) & (F.get(known, further - 1) <= own), further).otherwise(reached)

    return F.aggregate(F.array(*steps), F.lit(0), search)


def with_history(
    df: DataFrame,
    key: str,
    order: str,
    previous: Sequence[str],
    amount: Column,
    *,
    width: int = CHUNK,
) -> DataFrame:
    """Add what came earlier in each row's group.

    ``previous`` is a struct of the named columns of the row before (null for a
    first row), ``before`` the sum of ``amount`` over all earlier rows and
    ``total`` its sum over the group. ``order`` is an integer column, unique
    within a group; neither it nor ``key`` is null. Chunks hold about ``width`` rows
    of neighbouring (key, order), of one group or of many.
    """
    borders = borders_of(df, [key, order], -(-df.count() // width))
    rows = df.select(
        F.struct(*df.columns).alias("row"),
        F.col(key).alias("key"),
        F.col(order).alias("order"),
        F.struct(*previous).alias("held"),
        amount.cast("bigint").alias("amount"),
        chunk_of([F.col(key), F.col(order)], borders).alias("chunk"),
    )
    group = Window.partitionBy("chunk", "key")
    inner = group.orderBy("order")
    inside = rows.withColumns(
        {
            "previous": F.lag("held").over(inner),
            "before": F.coalesce(F.sum("amount").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "total": F.sum("amount").over(group),
            "is_last": F.lead("order").over(inner).isNull(),
        }
    )
    if not borders.values:
        return inside.select("row.*", "previous", "before", "total")
    # A row per group and chunk; only groups that lie in several chunks carry anything on.
    ends = inside.where("is_last").select("key", "chunk", "held", "total")
    across = Window.partitionBy("key").orderBy("chunk")
    carried = ends.select(
        "key",
        "chunk",
        F.lag("held").over(across).alias("border"),
        F.coalesce(F.sum("total").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("total").over(Window.partitionBy("key")).alias("all"),
        F.count(F.lit(1)).over(Window.partitionBy("key")).alias("chunks"),
    ).where("chunks > 1")
    return inside.join(carried.drop("chunks"), ["key", "chunk"], "left").select(
        "row.*",
        F.coalesce("previous", "border").alias("previous"),
        (F.col("before") + F.coalesce("offset", F.lit(0))).alias("before"),
        F.coalesce("all", "total").alias("total"),
    )


def with_place(df: DataFrame, order: str, name: str, *, width: int = CHUNK) -> DataFrame:
    """Adds a column ``name``: each row's place, from 0 without gaps, in the order of a text or integer column.

    Rows equal in ``order`` share a chunk and follow each other in any order.
    """
    borders = borders_of(df, [order], -(-df.count() // width))
    rows = df.withColumn("__chunk", chunk_of([F.col(order)], borders))
    inside = rows.withColumn(name, F.row_number().over(Window.partitionBy("__chunk").orderBy(order)) - 1)
    sizes = rows.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__rows"))
    # A row per chunk.
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__chunk", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    placed = inside.join(offsets, "__chunk")
    return placed.withColumn(name, (F.col(name) + F.col("__offset")).cast("bigint")).drop("__chunk", "__offset")
