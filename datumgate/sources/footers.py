"""File footers read on executors: true types, row counts, contract errors."""

from __future__ import annotations

from typing import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CORRUPTED_BATCH, INVALID_FORMAT, SCHEMA_MISMATCH, UNSUPPORTED_DATA_TYPE
from ..functions.types import arrow_canonical, declared_metadata, unsupported_message
from ..model import ARROW_IPC, PARQUET
from .files import is_partitioned, open_file
from .ipc_spans import batch_places

FOOTER_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("schema_json", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField(
            "fields",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("position", T.IntegerType()),
                        T.StructField("field", T.StringType()),
                        T.StructField("data_type", T.StringType()),
                        T.StructField("canonical", T.BooleanType()),
                    ]
                )
            ),
        ),
    ]
)


def open_ipc(source: pa.NativeFile, fields: list[int] | None = None):
    """Reader of an Arrow IPC file; falls back to the stream layout from the start.

    With ``fields`` only the buffers of those columns are read and decoded.
    """
    options = pa.ipc.IpcReadOptions(included_fields=fields) if fields else None
    try:
        return pa.ipc.open_file(source, options=options)
    except pa.ArrowInvalid:
        source.seek(0)
        return pa.ipc.open_stream(source, options=options)


def narrowest(schema: pa.Schema) -> str:
    """Name of the column that takes the fewest bytes a row."""
    widths = [f.type.bit_width if pa.types.is_primitive(f.type) else 1 << 16 for f in schema]
    return schema.names[widths.index(min(widths))]


def ipc_row_count(source: pa.NativeFile, schema: pa.Schema) -> int:
    """Rows of an IPC file or stream, from its message headers; nothing is decoded."""
    if not len(schema):
        return 0
    places = list(batch_places(source))
    source.seek(0)
    reader = open_ipc(source)
    if isinstance(reader, pa.ipc.RecordBatchFileReader) and reader.num_record_batches != len(places):
        # The index lists other batches than follow one another: it decides.
        field = schema.get_field_index(narrowest(schema))
        source.seek(0)
        return sum(batch.num_rows for batch in ipc_batches(open_ipc(source, [field])))
    return sum(place.rows for place in places)


def ipc_batches(reader, start: int = 0, stop: int | None = None) -> Iterator[pa.RecordBatch]:
    if isinstance(reader, pa.ipc.RecordBatchFileReader):
        for i in range(start, reader.num_record_batches if stop is None else stop):
            yield reader.get_batch(i)
    else:
        yield from reader


def inspect_footer(path: str, fmt: str | None, counts: bool = True) -> dict:
    """Facts of one file as a row of ``FOOTER_SCHEMA``; ``counts=False`` leaves IPC rows uncounted."""
    row = {name: None for name in FOOTER_SCHEMA.names}
    row.update(path=path, format=fmt)
    if fmt not in (PARQUET, ARROW_IPC):
        if fmt is None:
            row.update(error_code=INVALID_FORMAT, error_message=f"Cannot tell the storage format of {path}")
        return row
    import pyarrow.parquet as pq

    try:
        with open_file(path) as source:
            if fmt == PARQUET:
                footer = pq.ParquetFile(source)
                schema, row["row_count"] = footer.schema_arrow, footer.metadata.num_rows
            else:
                reader = open_ipc(source)
                schema = reader.schema
            types = [(f, arrow_canonical(f.type)) for f in schema]
            row["fields"] = [
                dict(position=i, field=f.name, data_type=known[0] if known else str(f.type), canonical=known is not None)
                for i, (f, known) in enumerate(types)
            ]
            bad = next((f for f, known in types if known is None), None)
            if bad is not None:
                row.update(error_code=UNSUPPORTED_DATA_TYPE, error_message=unsupported_message(bad.name, bad.type))
                return row
            row["schema_json"] = T.StructType(
                [T.StructField(f.name, t, True, declared_metadata(stored, t)) for f, (stored, t) in types]
            ).json()
            if fmt == ARROW_IPC and counts:
                # Only the batches themselves know their lengths.
                row["row_count"] = ipc_row_count(source, schema)
    except (pa.ArrowException, OSError) as broken:
        row.update(error_code=CORRUPTED_BATCH, error_message=str(broken), row_count=None, schema_json=None)
    return row


def _arrow_footer_schema() -> pa.Schema:
    field = pa.struct(
        [("position", pa.int32()), ("field", pa.string()), ("data_type", pa.string()), ("canonical", pa.bool_())]
    )
    texts = ("schema_json", "error_code", "error_message")
    return pa.schema(
        [("path", pa.string()), ("format", pa.string()), ("row_count", pa.int64())]
        + [(name, pa.string()) for name in texts]
        + [("fields", pa.list_(field))]
    )


def read_footers(files: DataFrame, keep: Sequence[str] = (), counts: bool = True) -> DataFrame:
    """The schema each ``(path, format)`` row's file states itself; ``keep`` passes columns through.

    Runs in the partitions the listing already has; nothing is shuffled. Types
    that Spark's reader hides (unsigned 64-bit, dictionary, duration) show here.
    """
    footer_schema = _arrow_footer_schema()
    kept = [files.schema[name] for name in keep]

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = zip(batch.column("path").to_pylist(), batch.column("format").to_pylist())
            rows = [inspect_footer(path, fmt, counts) for path, fmt in asked]
            facts = pa.RecordBatch.from_pylist(rows, schema=footer_schema)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + facts.columns, names=[f.name for f in kept] + facts.schema.names
            )

    wanted = files.select(*keep, "path", "format")
    return wanted.mapInArrow(inspect, T.StructType(kept + FOOTER_SCHEMA.fields))


def dataset_facts(typed: DataFrame, key: str, counts: bool = True, faults: DataFrame | None = None) -> DataFrame:
    """One row per dataset from its ``(key, relative_path, path, format)`` files, every file looked at.

    ``faults`` is ``(path, fault)`` of files whose data was found broken.

    Carries the schema and row count, or the first error: undetectable,
    unsupported type, corrupt, then files that differ in format or schema, or
    that are only partly in a Hive layout.
    """
    nanos = F.exists("fields", lambda f: f["data_type"].contains("Timestamp(Nanosecond"))
    rank = (
        F.when(F.col("error_code").isNull(), F.lit(9))
        .when(F.col("error_code") == INVALID_FORMAT, F.lit(1))
        .when(F.col("error_code") == CORRUPTED_BATCH, F.lit(3))
        .otherwise(F.lit(2))
    )
    worst = F.struct(rank.alias("rank"), F.col("path"), F.col("error_code"), F.col("error_message"))
    in_layout = is_partitioned(F.col("relative_path"))
    footers = read_footers(typed, keep=[key, "relative_path"], counts=counts)
    if faults is not None:
        footers = _with_faults(footers, faults)
    folded = footers.groupBy(key).agg(
        F.min("format").alias("format"),
        F.max("format").alias("other_format"),
        F.min("schema_json").alias("schema_json"),
        F.max("schema_json").alias("other_schema"),
        F.sum("row_count").alias("row_count"),
        F.max(nanos).alias("nanos"),
        F.min(in_layout).alias("all_partitioned"),
        F.max(in_layout).alias("partitioned"),
        F.min(worst).alias("worst"),
    )
    formats, schemas = F.col("format") != F.col("other_format"), F.col("schema_json") != F.col("other_schema")
    mixed = F.col("all_partitioned") != F.col("partitioned")
    code = (
        F.when(F.col("worst.error_code").isNotNull(), F.col("worst.error_code"))
        .when(formats, F.lit(INVALID_FORMAT))
        .when(schemas | mixed, F.lit(SCHEMA_MISMATCH))
    )
    message = (
        F.when(F.col("worst.error_code").isNotNull(), F.col("worst.error_message"))
        .when(formats, F.lit("Files of one dataset have different formats"))
        .when(schemas, F.lit("Files of one dataset have different schemas"))
        .when(mixed, F.lit("Only some files of one dataset lie in partition folders"))
    )
    return folded.select(
        key, "format", "schema_json", "row_count", "nanos", "partitioned", code.alias("error_code"), message.alias("error_message")
    )


def _with_faults(footers: DataFrame, faults: DataFrame) -> DataFrame:
    """Footers of files with broken data, as those of broken files."""
    broken = F.col("fault").isNotNull() & F.col("error_code").isNull()
    gone = lambda name: F.when(~broken, F.col(name))
    return footers.join(faults, "path", "left").withColumns(
        {
            "error_code": F.when(broken, F.lit(CORRUPTED_BATCH)).otherwise(F.col("error_code")),
            "error_message": F.when(broken, F.concat_ws(": ", "path", "fault")).otherwise(F.col("error_message")),
            "row_count": gone("row_count"),
            "schema_json": gone("schema_json"),
        }
    )


def footer_contract(files: DataFrame) -> DataFrame:
    """One row per (file, field): the type in the file and whether it is canonical."""
    return read_footers(files).select("path", F.inline("fields"))
