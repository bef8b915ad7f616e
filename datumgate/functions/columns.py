"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"


def quoted(name: str) -> str:
    """An exact column name as SQL text, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ref(name: str) -> Column:
    """Column by its exact name."""
    return F.col(quoted(name))


def ntz_micros_text(ntz: str) -> str:
    """SQL text: microseconds since the epoch of a zoneless timestamp, in any session zone."""
    return f"unix_micros(CAST(concat(CAST({ntz} AS string), 'Z') AS timestamp))"


def ntz_from_micros(micros: Column) -> Column:
    """Zoneless timestamp from microseconds since the epoch, in any session zone."""
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.expr(EPOCH_NTZ) + F.make_dt_interval(zero, zero, zero, seconds)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names wanted, with underscores before those that a column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
