"""Delimited text (CSV, TSV) as DataFrames of lines."""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidFormat, SchemaMismatch
from ..functions.cells import WHITE_SPACE, is_blank, split_cells, trim
from ..functions.columns import ref
from .files import filesystem_of, list_files

# Reading whole lines through the CSV source: separator, quote and escape are
# Unicode noncharacters, which text does not hold. That source is used because
# it skips the first non-blank line of every file, which the text source cannot.
_WHOLE_LINE = {
    "sep": chr(0xFDD1) + chr(0xFDD2) + chr(0xFDD1),
    "quote": chr(0xFDD3),
    "escape": chr(0xFDD4),
    "lineSep": "\n",
    "enforceSchema": "true",
}


def _as_list(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


# What a line is called until the keys are out of its way.
_LINE = "_datumgate_line"


def read_lines(spark: SparkSession, paths: str | list[str], *, skip_header: bool, keyed: bool = False) -> DataFrame:
    """Non-blank lines of all files below the paths, without each file's header line if asked.

    One narrow scan: files split at any block, no shuffle and no join. With ``keyed`` a struct ``keys`` of the
    partition folders' keys follows, as the scan itself types and filters them.
    """
    reader = spark.read.schema(f"{_LINE} string").option("recursiveFileLookup", str(not keyed).lower())
    if skip_header:
        lines = reader.options(header="true", **_WHOLE_LINE).csv(_as_list(paths))
    else:
        lines = reader.option("lineSep", "\n").text(_as_list(paths))
    keys = [name for name in lines.columns if name != _LINE]
    renamed = lines.withColumnRenamed(_LINE, "line")
    if keyed:
        renamed = lines.select(F.col(_LINE).alias("line"), F.struct(*[ref(k) for k in keys]).alias("keys"))
    return renamed.where(~is_blank(F.col("line")))


def leading_lines(files: DataFrame, limit: int) -> DataFrame:
    """``(path, rank, line)``: the first ``limit`` non-blank lines of each file, ranked from 1.

    Tasks open the files and stop after those lines, so the rest is never read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                lines = list(_first_lines(path, limit))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(lines), pa.string()),
                        pa.array(range(1, len(lines) + 1), pa.int64()),
                        pa.array(lines, pa.string()),
                    ],
                    names=["path", "rank", "line"],
                )

    return files.select("path").mapInArrow(read, "path string, rank bigint, line string")


def _first_lines(path: str, limit: int) -> Iterator[str]:
    """Non-blank lines from the start of a file, decompressed as its name says."""
    filesystem, place = filesystem_of(path)
    rest, found = b"", 0
    with filesystem.open_input_stream(place) as source:
        while found < limit:
            chunk = source.read(1 << 16)
            *lines, rest = (rest + chunk).split(b"\n") if chunk else (rest, b"")
            for line in lines:
                text = line.decode("utf-8", "replace")
                if found < limit and text.strip(WHITE_SPACE):
                    found += 1
                    yield text
            if not chunk:
                return


def first_lines(spark: SparkSession, paths: str | list[str], limit: int, *, skip_header: bool) -> DataFrame:
    """The first ``limit`` non-blank lines of every file, after its header line if asked."""
    skipped = 1 if skip_header else 0
    lines = leading_lines(list_files(spark, paths), max(limit, 0) + skipped)
    return lines.where(F.col("rank") > skipped).select("line")


def header_rows(files: DataFrame, key: str, delimiter: str) -> DataFrame:
    """``(key, path, cells, headers)`` per dataset: first file's first line and how many different ones its files have."""
    lines = leading_lines(files, 1).join(files.select(key, "path"), "path")
    cells = F.transform(split_cells(F.col("line"), delimiter), trim)
    first = F.min(F.struct("path", "cells"))
    # Different headers first: a dataset of many files leaves few rows per task.
    rows = lines.select(key, "path", cells.alias("cells")).groupBy(key, "cells").agg(F.min("path").alias("path"))
    return rows.groupBy(key).agg(first.alias("first"), F.count(F.lit(1)).alias("headers")).select(key, "first.*", "headers")


def names_of(row: Row | None, source: str, has_header: bool) -> list[str]:
    """Column names from a row of ``header_rows``: the header that all files share, or numbered names."""
    if row is None:
        raise InvalidFormat("No lines to infer a schema from")
    if has_header and row.headers > 1:
        raise SchemaMismatch(f"{source}: its files have {row.headers} different headers")
    return list(row.cells) if has_header else numbered(len(row.cells))


def header_cells(spark: SparkSession, paths: str | list[str], delimiter: str, has_header: bool) -> list[str]:
    """Column names of one dataset, whose files must agree on their header."""
    files = list_files(spark, paths).select("path", F.lit(0).alias("key"))
    row = next(iter(header_rows(files, "key", delimiter).collect()), None)
    return names_of(row, str(paths), has_header)


def numbered(count: int) -> list[str]:
    return [f"column_{i + 1}" for i in range(count)]


def join_cells(columns: list[Column], delimiter: str) -> Column:
    """One delimited line from column values; nulls become empty cells."""
    return F.concat_ws(delimiter, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
