"""The canonical type contract, on Spark types and on Arrow types."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

# Canonical type names of the scalar Spark types.
SPARK_SCALARS = {
    T.BooleanType: "Boolean",
    T.ByteType: "Int8",
    T.ShortType: "Int16",
    T.IntegerType: "Int32",
    T.LongType: "Int64",
    T.FloatType: "Float32",
    T.DoubleType: "Float64",
    T.DateType: "Date32",
    T.TimestampType: 'Timestamp(Microsecond, Some("UTC"))',
    T.TimestampNTZType: "Timestamp(Microsecond, None)",
}

# Canonical names of the scalar Arrow types, and the Spark type
# each one has once it is read.
ARROW_SCALARS = {
    pa.bool_(): ("Boolean", T.BooleanType()),
    pa.int8(): ("Int8", T.ByteType()),
    pa.int16(): ("Int16", T.ShortType()),
    pa.int32(): ("Int32", T.IntegerType()),
    pa.int64(): ("Int64", T.LongType()),
    pa.uint8(): ("UInt8", T.ShortType()),
    pa.uint16(): ("UInt16", T.IntegerType()),
    pa.uint32(): ("UInt32", T.LongType()),
    pa.uint64(): ("UInt64", T.DecimalType(20, 0)),
    pa.float32(): ("Float32", T.FloatType()),
    pa.float64(): ("Float64", T.DoubleType()),
    pa.string(): ("Utf8", T.StringType()),
    pa.large_string(): ("LargeUtf8", T.StringType()),
    pa.date32(): ("Date32", T.DateType()),
}

# Arrow time units that the contract admits for timestamps.
TIMESTAMP_UNITS = {"ms": "Millisecond", "us": "Microsecond", "ns": "Nanosecond"}


def canonical_name(dtype: T.DataType) -> str | None:
    """Canonical name of a Spark type, or None when the contract rejects it.

    ``decimal(20,0)`` is how Spark reads an unsigned 64-bit column; whether the
    file really holds one is decided by the footer check.
    """
    if isinstance(dtype, T.StringType) and type(dtype) is T.StringType:
        return "Utf8"
    if isinstance(dtype, T.DecimalType):
        return "UInt64" if (dtype.precision, dtype.scale) == (20, 0) else None
    if isinstance(dtype, T.ArrayType):
        inner = canonical_name(dtype.elementType)
        return f"List({inner})" if inner else None
    if isinstance(dtype, T.StructType):
        inners = [(f.name, canonical_name(f.dataType)) for f in dtype.fields]
        if all(name for _, name in inners):
            return "Struct(" + ", ".join(f"{n}: {t}" for n, t in inners) + ")"
        return None
    return SPARK_SCALARS.get(type(dtype))


def arrow_canonical(dtype: pa.DataType) -> tuple[str, T.DataType] | None:
    """Canonical name and Spark type of an Arrow type, None when rejected."""
    if dtype in ARROW_SCALARS:
        return ARROW_SCALARS[dtype]
    if pa.types.is_timestamp(dtype) and dtype.unit in TIMESTAMP_UNITS:
        zone = f'Some("{dtype.tz}")' if dtype.tz else "None"
        spark = T.TimestampType() if dtype.tz else T.TimestampNTZType()
        return f"Timestamp({TIMESTAMP_UNITS[dtype.unit]}, {zone})", spark
    if pa.types.is_list(dtype):
        inner = arrow_canonical(dtype.value_type)
        return inner and (f"List({inner[0]})", T.ArrayType(inner[1]))
    if pa.types.is_struct(dtype):
        members = [(f.name, arrow_canonical(f.type)) for f in dtype]
        if not all(inner for _, inner in members):
            return None
        name = ", ".join(f"{n}: {inner[0]}" for n, inner in members)
        spark = T.StructType([T.StructField(n, inner[1]) for n, inner in members])
        return f"Struct({name})", spark
    return None


#: Metadata key of a field: its canonical type where Spark's own type hides it.
STORED_TYPE = "stored_type"


def declared_name(field: T.StructField) -> str | None:
    """Canonical name of the type a field's file declares, as far as it is known."""
    return field.metadata.get(STORED_TYPE) or canonical_name(field.dataType)


def declared_metadata(stored: str, dtype: T.DataType) -> dict:
    """Field metadata that keeps a stored type Spark reads as another one."""
    return {} if stored == canonical_name(dtype) else {STORED_TYPE: stored}


def unsupported_message(field: str, dtype: object) -> str:
    return f"Field '{field}': {dtype} is not a supported canonical data type"
