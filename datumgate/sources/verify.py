"""Files decoded part by part in tasks: row groups of Parquet files, record batches of Arrow IPC files.

A first job reads the footers and names the parts; a shuffle of the names spreads them, so a large file
is decoded by many tasks, and a task holds one slice of a row group, however large that is, or one record
batch at a time. A part that fails is decoded again column by column, to tell which columns are broken. A
stream has no index: it is one part until its first broken batch.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptedBatch
from ..model import ARROW_IPC, PARQUET
from .files import open_file
from .footers import open_ipc

#: ``part`` counts from 0; null for a footer or header. ``column`` is null where no single column fails.
CHECKED = "path string, format string, part bigint, row_count bigint, column string, error string"
_PARTS = "path string, format string, part bigint, error string"
SLICE_ROWS = 1 << 14
# What is read ahead of each column; without it a column's whole part of the row group would be in memory.
READ_BYTES = 1 << 20
_BROKEN = (pa.ArrowException, OSError)


def _parquet(source: pa.NativeFile):
    import pyarrow.parquet as pq

    # Checksums of pages are compared where a file has them.
    return pq.ParquetFile(source, page_checksum_verification=True, buffer_size=READ_BYTES)


def _named(path: str, fmt: str) -> list[tuple]:
    """(part, error) of each part of a file; one row with the error where its footer cannot be read."""
    try:
        with open_file(path) as source:
            if fmt == PARQUET:
                return [(k, None) for k in range(_parquet(source).num_row_groups)]
            reader = open_ipc(source)
            if isinstance(reader, pa.ipc.RecordBatchFileReader):
                return [(k, None) for k in range(reader.num_record_batches)]
            return [(0, None)]
    except _BROKEN as broken:
        return [(None, str(broken))]


def parts_of(files: DataFrame) -> DataFrame:
    """(path, format, part, error) of the parts of (path, format) files; other formats have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, fmt in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                found = _named(path, fmt)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(found), pa.string()),
                        pa.array([fmt] * len(found), pa.string()),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.string()),
                    ],
                    names=["path", "format", "part", "error"],
                )

    return files.where(F.col("format").isin(PARQUET, ARROW_IPC)).select("path", "format").mapInArrow(run, _PARTS)


def _decoded(path: str, fmt: str, part: int, column: int | None = None) -> int:
    """Rows of a part, all of whose values, or those of one column, have been decoded and validated."""
    rows = 0
    with open_file(path) as source:
        if fmt == PARQUET:
            footer = _parquet(source)
            names = None if column is None else [footer.schema_arrow.names[column]]
            for batch in footer.iter_batches(SLICE_ROWS, row_groups=[part], columns=names):
                batch.validate(full=True)
                rows += batch.num_rows
            return rows
        reader = open_ipc(source, None if column is None else [column])
        if isinstance(reader, pa.ipc.RecordBatchFileReader):
            batch = reader.get_batch(part)
            batch.validate(full=True)
            return batch.num_rows
        for k, batch in enumerate(reader):
            try:
                batch.validate(full=True)
            except _BROKEN as broken:
                raise pa.ArrowInvalid(f"batch {k}: {broken}") from broken
            rows += batch.num_rows
        return rows


def _columns_of(path: str, fmt: str) -> list[str]:
    with open_file(path) as source:
        return (_parquet(source).schema_arrow if fmt == PARQUET else open_ipc(source).schema).names


def _checked(path: str, fmt: str, part: int) -> list[tuple]:
    """(row_count, column, error): one row for a sound part, else one for each broken column."""
    try:
        return [(_decoded(path, fmt, part), None, None)]
    except _BROKEN as broken:
        whole = (None, None, str(broken))
    found = []
    for k, name in enumerate(_columns_of(path, fmt)):
        try:
            _decoded(path, fmt, part, k)
        except _BROKEN as broken:
            found.append((None, name, str(broken)))
    # A batch whose header is broken fails whichever columns are asked for.
    return found if 0 < len(found) < len(_columns_of(path, fmt)) or len(found) == 1 else [whole]


def check_files(files: DataFrame) -> DataFrame:
    """Rows of ``CHECKED`` for (path, format) files: one per sound part, one per broken column of the others."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, fmt, part, error in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows = [(None, None, error)] if error is not None else _checked(path, fmt, part)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * n, pa.string()),
                        pa.array([fmt] * n, pa.string()),
                        pa.array([part] * n, pa.int64()),
                        *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))),
                    ],
                    names=["path", "format", "part", "row_count", "column", "error"],
                )

    # A number of tasks of its own: by their size alone the names would all go to one.
    return parts_of(files).repartition(tasks, "path", "part").mapInArrow(run, CHECKED)


def fault_message(part: Column, column: Column, error: Column, fmt: Column) -> Column:
    """A broken part in words."""
    unit = F.when(fmt == PARQUET, F.lit("row group")).otherwise(F.lit("record batch"))
    place = F.when(part.isNull(), F.lit("footer")).otherwise(F.concat_ws(" ", unit, part.cast("string")))
    return F.concat(place, F.coalesce(F.concat(F.lit(", column "), column), F.lit("")), F.lit(": "), error)


def first_faults(files: DataFrame) -> DataFrame:
    """(path, fault) of each broken file: its first broken part and column in words."""
    broken = check_files(files).where("error is not null")
    first = F.min(F.struct("part", "column", "error", "format")).alias("f")
    words = fault_message(F.col("f.part"), F.col("f.column"), F.col("f.error"), F.col("f.format"))
    return broken.groupBy("path").agg(first).select("path", words.alias("fault"))


def require_sound(spark: SparkSession, files: DataFrame) -> None:
    """Raises ``CorruptedBatch`` for the first broken file, by path; one row reaches the driver."""
    first = first_faults(files).agg(F.min(F.struct("path", "fault")).alias("first")).first().first
    if first is not None:
        raise CorruptedBatch(f"{first.path}: {first.fault}")
