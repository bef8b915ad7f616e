"""Schema inference for delimited text, and loading with the inferred types."""

from __future__ import annotations

from typing import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import NULL_CELL, TYPES, cell_mask, split_cells, trim, type_of_mask, typed_cell
from ..model import CsvOptions
from ..sources.delimited import first_lines, header_cells, leading_lines, read_lines
from ..sources.files import decoded_path, list_files, with_keys


def column_masks(lines: DataFrame, names: Sequence[str], options: CsvOptions = CsvOptions()) -> DataFrame:
    """``(position, column, mask, data_type)`` for data lines in column ``line``.

    The merge of cell kinds is a bitwise OR: every task sends one row per column.
    Missing cells add nothing and surplus cells are not looked at.
    """
    # A line always has a cell; the outer form spares a filter that splits it again.
    cells = lines.select(F.posexplode_outer(split_cells(F.col("line"), options.delimiter)).alias("position", "raw"))
    trimmed = cells.where(F.col("position") < len(names)).select("position", trim(F.col("raw")).alias("cell"))
    kinds = trimmed.select("position", cell_mask(F.col("cell"), options.null_values).alias("mask"))
    merged = kinds.groupBy("position").agg(F.bit_or("mask").alias("mask"))
    columns = {"position": pa.array(range(len(names)), pa.int32()), "column": pa.array(names, pa.string())}
    listed = lines.sparkSession.createDataFrame(pa.table(columns))
    # One row per column at most, so the broadcast is bounded by the header.
    found = listed.join(F.broadcast(merged), "position", "left")
    mask = F.coalesce("mask", F.lit(NULL_CELL)).alias("mask")
    return found.select("position", "column", mask).withColumn("data_type", type_of_mask(F.col("mask")))


def file_masks(spark: SparkSession, paths: list[str], options: CsvOptions) -> DataFrame:
    """``(path, position, mask, lines)`` of every file, all from one pass over the text.

    Folded per file and position in the tasks, so however many datasets the
    files belong to, their lines are never shuffled. Every line has a cell at
    position 0, whose ``lines`` is the file's row count.
    """
    lines = read_lines(spark, paths, skip_header=options.has_header)
    lines = lines.select(decoded_path(F.col("_metadata.file_path")).alias("path"), "line")
    if options.max_sample_rows is None:
        return _folded(lines, options)
    skipped = 1 if options.has_header else 0
    sample = leading_lines(list_files(spark, paths), max(options.max_sample_rows, 0)).where(F.col("rank") > skipped)
    masks = _folded(sample, options).drop("lines")
    counts = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines")).withColumn("position", F.lit(0))
    return masks.join(counts, ["path", "position"], "full")


def _folded(lines: DataFrame, options: CsvOptions) -> DataFrame:
    cells = lines.select("path", F.posexplode_outer(split_cells(F.col("line"), options.delimiter)).alias("position", "raw"))
    kinds = cells.select("path", "position", cell_mask(trim(F.col("raw")), options.null_values).alias("mask"))
    return kinds.groupBy("path", "position").agg(F.bit_or("mask").alias("mask"), F.count(F.lit(1)).alias("lines"))


def schema_of(masks: DataFrame) -> T.StructType:
    """The inferred schema; every field is nullable."""
    rows = sorted(masks.collect(), key=lambda r: r.position)
    return T.StructType([T.StructField(r.column, TYPES[r.data_type], True) for r in rows])


def infer_masks(spark: SparkSession, paths: str | list[str], options: CsvOptions = CsvOptions()) -> DataFrame:
    names = header_cells(spark, paths, options.delimiter, options.has_header)
    if options.max_sample_rows is None:
        lines = read_lines(spark, paths, skip_header=options.has_header)
    else:
        data_lines = options.max_sample_rows - (1 if options.has_header else 0)
        lines = first_lines(spark, paths, data_lines, skip_header=options.has_header)
    return column_masks(lines, names, options)


def infer_schema(spark: SparkSession, paths: str | list[str], options: CsvOptions = CsvOptions()) -> T.StructType:
    """Schema of delimited files; raises ``InvalidFormat`` when they have no line."""
    return schema_of(infer_masks(spark, paths, options))


def load_lines(lines: DataFrame, schema: T.StructType, options: CsvOptions = CsvOptions()) -> DataFrame:
    """Typed rows from data lines; the fields of a struct ``keys`` beside the line follow."""
    keys = [f.name for f in lines.schema["keys"].dataType.fields] if "keys" in lines.columns else []
    carried = ["keys"] if keys else []
    cells = lines.select(split_cells(F.col("line"), options.delimiter).alias("cells"), *carried)
    raw = [trim(F.get("cells", F.lit(i))).alias(f"cell_{i}") for i in range(len(schema.fields))]
    trimmed = cells.select(*raw, *carried)
    return trimmed.select(
        *[
            typed_cell(f"cell_{i}", field.dataType, options.null_values).alias(field.name)
            for i, field in enumerate(schema.fields)
        ],
        *[F.col("keys").getField(k).alias(k) for k in keys],
    )


def load_delimited(
    spark: SparkSession,
    paths: str | list[str],
    options: CsvOptions = CsvOptions(),
    schema: T.StructType | None = None,
    partitioned: bool = False,
) -> DataFrame:
    """Typed rows of delimited files, inferring the schema when none is given.

    With ``partitioned`` the keys of folders named ``key=value`` follow the columns of the files.
    """
    schema = schema or infer_schema(spark, paths, options)
    lines = read_lines(spark, paths, skip_header=options.has_header, keyed=partitioned)
    if partitioned:
        with_keys(schema, lines.schema["keys"].dataType, str(paths))
    return load_lines(lines, schema, options)
