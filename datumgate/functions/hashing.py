"""Hash expressions: row text, additive digests, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import quoted

# A digest is summed as four 60-bit words of a SHA-256, each cut
# in three 20-bit limbs. A sum of limbs stays within a bigint for 2^43 rows.
WORDS, WORD_DIGITS, LIMBS, LIMB_BITS = 4, 15, 3, 20


def value_text(field: T.StructField) -> str:
    """SQL text: one value as a string, the same in every session zone."""
    name, dtype = quoted(field.name), field.dataType
    if isinstance(dtype, T.TimestampType):
        return f"CAST(unix_micros({name}) AS string)"
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return f"to_json(struct({name} AS v), map('ignoreNullFields', 'false', 'timeZone', 'UTC'))"
    if isinstance(dtype, T.BinaryType):
        return f"hex({name})"
    return f"CAST({name} AS string)"


def row_text(schema: T.StructType) -> Column:
    """One string per row: ``N`` for null, else ``V<length>:<text>``, in schema order."""
    parts = ["''"]
    for field in schema.fields:
        text = value_text(field)
        parts.append(f"coalesce(concat('V', length({text}), ':', {text}), 'N')")
    return F.expr(f"concat({', '.join(parts)})")


def limb_sums(digest: Column) -> list[Column]:
    """Partial sums of a hex SHA-256 column; only bigint additions."""
    sums = []
    for w in range(WORDS):
        digits = F.substring(digest, 1 + w * WORD_DIGITS, WORD_DIGITS)
        word = F.conv(digits, 16, 10).cast("bigint")
        for limb in range(LIMBS):
            part = F.shiftright(word, limb * LIMB_BITS).bitwiseAND(F.lit((1 << LIMB_BITS) - 1))
            sums.append(F.sum(part).alias(f"w{w}_{limb}"))
    return sums


def word_totals() -> list[Column]:
    """The four word sums from the columns ``limb_sums`` made."""
    totals = []
    for w in range(WORDS):
        total = F.lit(0).cast("decimal(38,0)")
        for limb in range(LIMBS):
            scale = F.lit(1 << (limb * LIMB_BITS)).cast("decimal(14,0)")
            total = (total + (F.coalesce(F.col(f"w{w}_{limb}"), F.lit(0)).cast("decimal(20,0)") * scale)).cast(
                "decimal(38,0)"
            )
        totals.append(total.alias(f"s{w}"))
    return totals


def digest_text(*parts: Column) -> Column:
    """SHA-256 over parts joined by colons."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def identifier(*parts: Column) -> Column:
    """A UUID (version 8, from a hash) that names the same thing on every run.

    A random identifier would change when a lost task is computed again.
    """
    digest = digest_text(*parts)
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-8"),
        F.substring(digest, 14, 3),
        F.lit("-8"),
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )
