"""Column profiles: counts, nulls, minimum, maximum, approximate distinct.

A profile is one ungrouped aggregation over the scan: every task folds its
rows into a single partial row, so the only shuffle is one row per task, and
Catalyst prunes the scan to the profiled columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ntz_micros_text, quoted, ref, text_literal
from ..functions.types import canonical_name, declared_name

# Each (family, type) pair is carried as min_<family> and max_<family>. Exactly
# one family is filled per column, so that no value is turned into text.
FAMILIES = (
    ("long", "bigint"),
    ("decimal", "decimal(20,0)"),
    ("double", "double"),
    ("string", "string"),
)
EXTENDED_FAMILIES = (
    ("boolean", "boolean"),
    ("date", "date"),
    ("timestamp_us", "bigint"),
)

# One generated aggregate covers at most this many columns.
COLUMNS_PER_PASS = 100
# Size of a distinct sketch: 2 ** 12 registers, a standard error of about 1.6 %.
SKETCH_BITS = 12


def _family(dtype: T.DataType, extended: bool, bounds: bool = True) -> str | None:
    if not bounds:
        return None
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    if isinstance(dtype, T.DecimalType) and canonical_name(dtype):
        return "decimal"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, T.StringType):
        return "string"
    if extended:
        if isinstance(dtype, T.BooleanType):
            return "boolean"
        if isinstance(dtype, T.DateType):
            return "date"
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return "timestamp_us"
    return None


def _families(extended: bool) -> tuple[tuple[str, str], ...]:
    return FAMILIES + EXTENDED_FAMILIES if extended else FAMILIES


# The expressions below are SQL text: a table has many columns and each costs
# one call to the JVM this way, instead of one per operator in its expression.


def _aggregates(
    fields: list[tuple[int, T.StructField]], extended: bool, rsd: float | None, bounds: bool, sketches: bool
) -> list[str]:
    aggs = ["count(1) AS rows"]
    for i, field in fields:
        name = quoted(field.name)
        aggs.append(f"count({name}) AS present_{i}")
        if _family(field.dataType, extended, bounds):
            # NaN takes no part in minimum and maximum.
            floating = isinstance(field.dataType, (T.FloatType, T.DoubleType))
            value = f"CASE WHEN NOT isnan({name}) THEN {name} END" if floating else name
            aggs += [f"min({value}) AS min_{i}", f"max({value}) AS max_{i}"]
        if rsd is not None:
            aggs.append(f"approx_count_distinct({name}, {rsd}D) AS distinct_{i}")
        if sketches:
            aggs.append(f"hll_sketch_agg({_hashable(name, field.dataType)}, {SKETCH_BITS}) AS sketch_{i}")
    return aggs


def _hashable(name: str, dtype: T.DataType) -> str:
    """A column as a type that distinct sketches take."""
    if isinstance(dtype, (T.IntegerType, T.LongType, T.StringType)):
        return name
    return f"to_json(struct({name}))" if isinstance(dtype, (T.ArrayType, T.StructType)) else f"CAST({name} AS string)"


def _state(i: int, field: T.StructField, extended: bool, rsd: float | None, bounds: bool, sketches: bool) -> str:
    family = _family(field.dataType, extended, bounds)
    kind = declared_name(field) or field.dataType.simpleString()
    parts = [
        f"{i} AS position",
        f"{text_literal(field.name)} AS column",
        f"{text_literal(kind)} AS data_type",
        "rows AS total_count",
        f"rows - present_{i} AS null_count",
        f"CAST({'NULL' if rsd is None else f'distinct_{i}'} AS bigint) AS distinct_count_approx",
    ]
    for name, sql_type in _families(extended):
        for side in ("min", "max"):
            value = f"{side}_{i}" if name == family else "NULL"
            if name == family and isinstance(field.dataType, T.TimestampNTZType):
                value = ntz_micros_text(value)
            elif name == family and isinstance(field.dataType, T.TimestampType):
                value = f"unix_micros({value})"
            parts.append(f"CAST({value} AS {sql_type}) AS {side}_{name}")
    if sketches:
        parts.append(f"sketch_{i} AS distinct_sketch")
    return f"struct({', '.join(parts)})"


def _summary_state(extended: bool, sketches: bool) -> str:
    parts = [
        "-1 AS position",
        "CAST(NULL AS string) AS column",
        "CAST(NULL AS string) AS data_type",
        "rows AS total_count",
        "0L AS null_count",
        "CAST(NULL AS bigint) AS distinct_count_approx",
    ]
    for name, sql_type in _families(extended):
        parts += [f"CAST(NULL AS {sql_type}) AS {side}_{name}" for side in ("min", "max")]
    if sketches:
        parts.append("CAST(NULL AS binary) AS distinct_sketch")
    return f"struct({', '.join(parts)})"


def null_percentage(nulls: Column, total: Column) -> Column:
    return F.when(total > 0, nulls.cast("double") / total.cast("double") * 100.0).otherwise(F.lit(0.0))


def with_percentage(states: DataFrame) -> DataFrame:
    columns = states.columns
    at = columns.index("null_count") + 1
    pct = null_percentage(F.col("null_count"), F.col("total_count")).alias("null_percentage")
    return states.select(*columns[:at], pct, *columns[at:])


def column_states(
    df: DataFrame,
    *,
    by: list[str] | None = None,
    extended: bool = False,
    rsd: float | None = None,
    summary: bool = False,
    bounds: bool = True,
    sketches: bool = False,
) -> DataFrame:
    """Mergeable profile, one row per column (and per ``by`` group).

    ``summary=True`` adds one row with a null column name and the row count,
    from the same pass over the data. ``bounds=False`` leaves minimum and maximum
    out, for checks that only count. ``sketches=True`` adds a distinct sketch
    that ``merge_states`` can fold.

    Bounds of texts cannot be held in a hash aggregate, so under ``by`` texts are
    folded apart: only their columns are sorted.
    """
    by = by or []
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if f.name not in by]
    groups = [fields]
    if by and bounds and not sketches:
        texts = [f for f in fields if isinstance(f[1].dataType, T.StringType)]
        groups = [g for g in ([f for f in fields if f not in texts], texts) if g]
    chunks = [g[at : at + COLUMNS_PER_PASS] for g in groups for at in range(0, len(g), COLUMNS_PER_PASS)] or [[]]
    keys = [ref(name) for name in by]
    names = [quoted(name) for name in by]
    frames = []
    for at, chunk in enumerate(chunks):
        states = [_state(i, f, extended, rsd, bounds, sketches) for i, f in chunk]
        if summary and at == 0:
            states.append(_summary_state(extended, sketches))
        folded = df.groupBy(*keys).agg(*[F.expr(a) for a in _aggregates(chunk, extended, rsd, bounds, sketches)])
        if not states:
            return folded.selectExpr(*names, f"inline(array({_summary_state(extended, sketches)}))").where("position >= 0")
        frames.append(folded.selectExpr(*names, f"inline(array({', '.join(states)}))"))
    return reduce(DataFrame.unionByName, frames)


def profile_columns(df: DataFrame, *, extended: bool = False, approx_distinct: float | None = None) -> DataFrame:
    """One row per column.

    Minimum and maximum cover integers, floats (NaN skipped) and strings (byte
    order); ``extended`` adds booleans, dates and timestamps. ``approx_distinct``
    is the relative standard deviation of the distinct sketch.
    """
    return with_percentage(column_states(df, extended=extended, rsd=approx_distinct))


def profile_with_summary(df: DataFrame, **options) -> DataFrame:
    """The profile plus one row (null column name) that carries the row count."""
    return with_percentage(column_states(df, summary=True, **options))


def merge_states(states: DataFrame) -> DataFrame:
    """Fold the states of several parts of a dataset into its whole profile.

    Parts may be partitions profiled on different days: states add up, so a
    growing dataset never needs its old files read again. The distinct count
    is known when the states hold sketches.
    """
    held = "distinct_sketch" in states.columns
    distinct = [F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_count_approx")] if held else []
    sides = [c for c in states.columns if c.startswith(("min_", "max_"))]
    folded = states.groupBy("position", "column", "data_type").agg(
        F.sum("total_count").alias("total_count"),
        F.sum("null_count").alias("null_count"),
        *[(F.min if c.startswith("min_") else F.max)(c).alias(c) for c in sides],
        *distinct,
    )
    merged = folded if held else folded.withColumn("distinct_count_approx", F.lit(None).cast("bigint"))
    order = [c for c in states.columns if c in merged.columns]
    return with_percentage(merged.select(*order))


def exact_distinct(df: DataFrame) -> DataFrame:
    """Exact number of distinct non-null values per column.

    One branch per column: each reads only its column, drops duplicates within
    a task before the shuffle and spreads the values by their hash, so a value
    that fills a third of the rows costs one row per task. A single aggregate
    with many distinct columns would instead copy every row once per column.
    """
    branches = []
    for i, field in enumerate(df.schema.fields):
        values = df.select(ref(field.name).alias("v")).where("v is not null").distinct()
        branches.append(
            values.agg(F.count(F.lit(1)).alias("distinct_count")).select(
                F.lit(i).alias("position"), F.lit(field.name).alias("column"), "distinct_count"
            )
        )
    return reduce(DataFrame.unionByName, branches)
