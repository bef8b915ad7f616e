"""Arrow IPC: files planned and read in spans of record batches, and IPC buffers as DataFrame rows."""

from __future__ import annotations

import itertools
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import CorruptedBatch, SchemaMismatch, UnsupportedDataType
from ..functions.columns import ref
from ..functions.types import arrow_canonical, unsupported_message
from ..operators.contract import require_canonical
from .files import filesystem_of, list_files, open_file, with_keys
from .footers import ipc_batches, narrowest, open_ipc
from .ipc_spans import stream_spans

# Bytes one input partition aims for, and the cost of opening a further file.
PARTITION_BYTES = 128 << 20
OPEN_COST_BYTES = 4 << 20

IPC_ROWS = "n bigint, ipc binary"


def spark_schema(schema: pa.Schema) -> T.StructType:
    """Spark schema of an Arrow schema; raises when the contract rejects a field."""
    fields = []
    for field in schema:
        known = arrow_canonical(field.type)
        if known is None:
            raise UnsupportedDataType(unsupported_message(field.name, field.type))
        fields.append(T.StructField(field.name, known[1], True))
    return T.StructType(fields)


def _spark_arrow_type(dtype: pa.DataType) -> pa.DataType:
    """The Arrow type Spark expects for a column of ``dtype``."""
    widened = {
        pa.uint8(): pa.int16(),
        pa.uint16(): pa.int32(),
        pa.uint32(): pa.int64(),
        pa.uint64(): pa.decimal128(20, 0),
        pa.large_string(): pa.string(),
    }
    if pa.types.is_timestamp(dtype):
        return pa.timestamp("us", tz="UTC" if dtype.tz else None)
    if pa.types.is_list(dtype):
        return pa.list_(_spark_arrow_type(dtype.value_type))
    if pa.types.is_struct(dtype):
        return pa.struct([(f.name, _spark_arrow_type(f.type)) for f in dtype])
    return widened.get(dtype, dtype)


def _floor_to_micros(column: pa.Array) -> pa.Array:
    nulls = np.asarray(column.is_null())
    nanos = np.asarray(column.cast(pa.int64()).fill_null(0))
    micros = pa.array(np.floor_divide(nanos, 1000), pa.int64(), mask=nulls)
    return micros.cast(pa.timestamp("us", tz=column.type.tz))


def _for_spark(batch: pa.RecordBatch, wanted: T.StructType, source: str) -> pa.RecordBatch:
    """The columns of ``wanted``, looked up by name; ``source`` names the file in errors."""
    columns = []
    for field in wanted:
        places = batch.schema.get_all_field_indices(field.name)
        if len(places) != 1:
            raise SchemaMismatch(f"{source}: column {field.name!r} found {len(places)} times")
        column = batch.column(places[0])
        stored = spark_schema(pa.schema([batch.schema.field(places[0])])).fields[0].dataType
        if stored != field.dataType:
            raise SchemaMismatch(
                f"{source}: column {field.name!r} is {stored.simpleString()}, not {field.dataType.simpleString()}"
            )
        if pa.types.is_timestamp(column.type) and column.type.unit == "ns":
            column = _floor_to_micros(column)
        columns.append(column.cast(_spark_arrow_type(column.type), safe=False))
    return pa.RecordBatch.from_arrays(columns, names=wanted.names)


SPANS = "path string, first bigint, stop bigint, at bigint"


def _spans(files: DataFrame, span_bytes: int) -> DataFrame:
    """The files' rows with ``first``, ``stop``, ``at``: each file cut into runs of record batches.

    Only files above ``span_bytes`` are opened, in the tasks. A file is cut by its index, a stream by a walk over its
    message headers; there ``at`` is the byte where the run's first batch begins.
    """
    kept = [f for f in files.schema.fields if f.name not in ("path", "length")]
    schema = T.StructType(T.StructType.fromDDL(SPANS).fields + kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True)
            rows = [(k, *span) for k, (path, size) in enumerate(sizes) for span in _cut(path, size, span_bytes)]
            source = pa.array([r[0] for r in rows], pa.int64())
            places = [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]
            carried = [batch.column(f.name).take(source) for f in kept]
            yield pa.RecordBatch.from_arrays([batch.column("path").take(source), *places, *carried], names=schema.names)

    return files.mapInArrow(cut, schema)


def _cut(path: str, size: int, span_bytes: int) -> list[tuple[int, int | None, int | None]]:
    """(first, stop, at) of one file's spans."""
    if size <= span_bytes:
        return [(0, None, None)]
    with open_file(path) as source:
        try:
            reader = open_ipc(source)
            if isinstance(reader, pa.ipc.RecordBatchFileReader):
                count = reader.num_record_batches
                step = max(1, count * span_bytes // size)
                return [(first, min(first + step, count), None) for first in range(0, count, step)]
            return [(0, batches, at) for at, batches, _ in stream_spans(source, span_bytes)]
        except pa.ArrowInvalid as broken:
            raise CorruptedBatch(f"{path}: {broken}") from broken


def _read_span(span: dict, wanted: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows of one span; of a file, buffers of other columns are not read."""
    uri = span["path"]
    with open_file(uri) as source:
        try:
            held = open_ipc(source).schema
            # Without columns (all asked for are keys) the narrowest one tells the rows.
            names = wanted.names or [narrowest(held)] if len(held) else []
            places = [held.get_field_index(name) for name in names]
            # A name that is absent or double is reported from the whole batch.
            fields = None if -1 in places else sorted(places)
            source.seek(0)
            reader = open_ipc(source, fields)
            if span["at"] is None:
                batches = ipc_batches(reader, span["first"], span["stop"])
            else:
                # The schema is read; the reader goes on at the run's first batch.
                source.seek(span["at"])
                batches = itertools.islice(reader, span["stop"])
            for batch in batches:
                yield _for_spark(batch, wanted, uri) if wanted.names else batch
        except pa.ArrowInvalid as broken:
            raise CorruptedBatch(f"{uri}: {broken}") from broken


def ipc_schema(uri: str) -> T.StructType:
    """Schema of one IPC file or stream, from its header alone."""
    try:
        with open_file(uri) as source:
            return spark_schema(open_ipc(source).schema)
    except pa.ArrowException as broken:
        raise CorruptedBatch(str(broken)) from broken


def read_ipc(
    spark: SparkSession,
    paths: str | list[str],
    *,
    columns: list[str] | None = None,
    partition_bytes: int = PARTITION_BYTES,
    partitioned: bool = False,
    where: Column | None = None,
) -> DataFrame:
    """Rows of Arrow IPC files (either layout). ``columns`` are the only ones read.

    With ``partitioned`` folders named ``key=value`` become columns behind the stored ones, typed as in Parquet
    scans. ``where`` is a condition on these keys; files it refuses are never opened. The driver sees one schema and
    the total size; tasks list the spans, and a shuffle of their names spreads them evenly. Files and streams
    above ``partition_bytes`` are read by several tasks.
    """
    listed = list_files(spark, paths, keyed=partitioned).where("length > 0")
    keys = T.StructType(listed.schema.fields[2:])
    kept = listed if where is None else listed.where(where)
    # Names of their own: a key may be called like a column of the spans.
    files = kept.select("path", "length", *[ref(k).alias(f"key_{k}") for k in keys.names])
    cost = F.col("length") + F.lit(min(OPEN_COST_BYTES, partition_bytes))
    [total] = files.agg(F.min("path").alias("first"), F.coalesce(F.sum(cost), F.lit(0)).alias("bytes")).collect()
    # Where no file is left, the schema of any file is that of the empty result.
    first = total.first if total.first is not None or where is None else listed.agg(F.min("path")).first()[0]
    if first is None:
        raise CorruptedBatch(f"no Arrow IPC data below {paths}")
    schema = with_keys(ipc_schema(first), keys, str(paths))
    if columns is not None:
        schema = T.StructType([schema[c] for c in columns])
    stored = T.StructType([f for f in schema if f.name not in keys.names])
    spans = _spans(files, partition_bytes).repartition(1 + total.bytes // partition_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, span in enumerate(batch.to_pylist()):
                held = {f.name: batch.column(f"key_{f.name}")[k] for f in schema if f.name in keys.names}
                for rows in _read_span(span, stored):
                    yield _keyed(rows, held, schema)

    return spans.mapInArrow(read, schema)


def _keyed(rows: pa.RecordBatch, held: dict[str, pa.Scalar], schema: T.StructType) -> pa.RecordBatch:
    """The columns of ``schema``: those held by the folder's name, repeated, the others from the rows."""
    columns = [pa.repeat(held[n], rows.num_rows) if n in held else rows.column(n) for n in schema.names]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _unsigned(batch: pa.RecordBatch) -> pa.RecordBatch:
    """64-bit unsigned integers, which Spark holds as decimal(20,0), as they were."""
    columns = [c.cast(pa.uint64()) if c.type == pa.decimal128(20, 0) else c for c in batch.columns]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def serialize(df: DataFrame) -> DataFrame:
    """Rows as IPC stream buffers, one self-describing buffer per Arrow batch."""
    require_canonical(df.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _unsigned(batch)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            buffer = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), buffer], names=["n", "ipc"])

    return df.mapInArrow(pack, IPC_ROWS)


def deserialize(buffers: DataFrame, schema: T.StructType, column: str = "ipc") -> DataFrame:
    """Rows from IPC stream buffers. The contract and ``schema`` are checked per buffer."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for buffer in rows.column(0):
                try:
                    with pa.ipc.open_stream(buffer.as_buffer()) as reader:
                        spark_schema(reader.schema)
                        for batch in reader:
                            yield _for_spark(batch, schema, "buffer")
                except pa.ArrowInvalid as broken:
                    raise CorruptedBatch(str(broken)) from broken

    return buffers.select(column).mapInArrow(unpack, schema)


def write_ipc(df: DataFrame, folder: str, layout: str = "file") -> list[str]:
    """Write one IPC file per partition; returns the paths of the files that count.

    Every task attempt writes a name of its own, which begins with this call's
    token, and reports it with its rows. Files of this call that Spark did not
    accept are deleted at the end, so a task that ran twice leaves no double rows;
    other files of the folder stay. Without rows one file with the schema is written.
    """
    require_canonical(df.schema)
    new_writer = pa.ipc.new_file if layout == "file" else pa.ipc.new_stream
    prefix = f"part-{uuid.uuid4().hex}-"

    def save(uri: str, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> None:
        filesystem, path = filesystem_of(uri)
        filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with filesystem.open_output_stream(path) as sink, new_writer(sink, schema) as writer:
            for batch in batches:
                writer.write_batch(batch)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = map(_unsigned, batches)
        first = next(ready, None)
        if first is None:
            return
        uri = f"{folder}/{prefix}{uuid.uuid4().hex}.arrow"
        save(uri, itertools.chain([first], ready), first.schema)
        yield pa.RecordBatch.from_arrays([pa.array([uri], pa.string())], names=["path"])

    accepted = [r.path for r in df.mapInArrow(write, "path string").collect()]
    if not accepted:
        nothing = _unsigned(pa.RecordBatch.from_pylist([], to_arrow_schema(df.schema)))
        accepted = [f"{folder}/{prefix}empty.arrow"]
        save(accepted[0], iter(()), nothing.schema)
    filesystem, root = filesystem_of(folder)
    names = {uri.rsplit("/", 1)[1] for uri in accepted}
    for info in filesystem.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(prefix) and info.base_name not in names:
            filesystem.delete_file(info.path)
    return accepted
