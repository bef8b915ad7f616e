"""Delimited text as column expressions: splitting, classifying, typing cells."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import text_literal

# The Unicode White_Space characters, which trimming removes.
ASCII_SPACE = "\t\n\x0b\x0c\r "
WHITE_SPACE = ASCII_SPACE + "".join(
    map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)

# One bit per kind of cell. A null cell has no bit, so that the
# kinds of a whole column are the bitwise OR over its cells.
NULL_CELL, BOOLEAN, INT64, FLOAT64, DATE, TIMESTAMP, TEXT = 0, 1, 2, 4, 8, 16, 32

# The accepted spellings of typed cells.
INT_PATTERN = "^[+-]?[0-9]+$"
FLOAT_PATTERN = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
FLOAT_WORDS = ("inf", "infinity", "nan")
DATE_PATTERN = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
LOCAL_TIME_PATTERN = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"
OFFSET_TIME_PATTERN = (
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?"
    "([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$"
)
WRITTEN_TIME_PATTERN = "^(.{19}([.][0-9]+)?)"
OFFSET_PATTERN = "([+-][0-9]{2}:[0-9]{2})$"
SIGNED_WORD_PATTERN = "^[+-](?i:inf|infinity|nan)$"

# The same spellings with the calendar and the clock in them: what fits needs no cast. A cast that fails raises and
# catches an exception for each cell.
_LEAP_YEAR = "(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"


def _day_pattern(zero: str) -> str:
    """A day of the calendar; ``zero`` is how the zero before one digit is asked for."""
    short = f"(?:{zero}[1-9]|1[0-2])-(?:{zero}[1-9]|1[0-9]|2[0-8])"
    longer = f"(?:{zero}[13-9]|1[0-2])-(?:29|30)|(?:{zero}[13578]|1[02])-31"
    return f"(?:[0-9]{{4}}-(?:{short}|{longer})|{_LEAP_YEAR}-{zero}2-29)"


REAL_DATE_PATTERN = f"^{_day_pattern('0?')}$"
REAL_LOCAL_TIME_PATTERN = f"^{_day_pattern('0?')}[ T](?:[01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]$"
REAL_OFFSET_TIME_PATTERN = (
    f"^{_day_pattern('0')}[Tt](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:[.][0-9]+)?"
    "(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])$"
)
# The longest local time.
LOCAL_TIME_SIZE = 19
_MAX_BIGINT, _MIN_BIGINT = str(2**63 - 1), str(2**63)

# A Unicode noncharacter and a second one stand in for delimiters outside
# quotes; where a line holds the first itself, it is doubled by a third.
_MARK = chr(0xFDD0)
_CUT, _KEPT = _MARK + chr(0xFDD5), _MARK + chr(0xFDD6)


def trim(text: Column) -> Column:
    """Without white space at both ends.

    A look at the ends settles most texts; those with characters beyond ASCII
    are always trimmed.
    """
    spaced = (text < "!") | (F.octet_length(text) != F.length(text))
    for blank in ASCII_SPACE:
        spaced |= F.endswith(text, F.lit(blank))
    return F.when(spaced, F.trim(text, F.lit(WHITE_SPACE))).otherwise(text)


def is_blank(text: Column) -> Column:
    return trim(text) == ""


def split_cells(line: Column, delimiter: str) -> Column:
    """Cells of one line, not yet trimmed.

    A quote switches quoting on or off and is dropped; the delimiter separates
    cells only outside quotes. Most lines have no quote and take the plain
    split; the others are cut at their quotes, where every second piece is
    quoted text.
    """
    plain = F.split(line, re.escape(delimiter), -1)
    marked = F.transform(
        F.split(F.replace(line, F.lit(_MARK), F.lit(_KEPT)), '"', -1),
        lambda piece, i: F.when(i % 2 == 0, F.replace(piece, F.lit(delimiter), F.lit(_CUT))).otherwise(piece),
    )
    cut = F.split(F.array_join(marked, ""), _CUT, -1)
    quoted = F.transform(cut, lambda cell: F.replace(cell, F.lit(_KEPT), F.lit(_MARK)))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)


def cell_mask(cell: Column, null_values: Sequence[str]) -> Column:
    """Kind of one trimmed cell as a bit.

    Cheap tests route a cell to the few patterns it could match: only cells that
    start between ``+`` and ``9`` can be numbers or dates, and only those with a
    dash after four characters can be dates. Nothing is cast: a failing cast costs far more than a pattern.
    """
    size = F.octet_length(cell)
    real = cell.rlike(FLOAT_PATTERN)
    dashed = (
        F.when((size <= 10) & cell.rlike(REAL_DATE_PATTERN), F.lit(DATE))
        .when(size.between(11, LOCAL_TIME_SIZE) & cell.rlike(REAL_LOCAL_TIME_PATTERN), F.lit(TIMESTAMP))
        .when((size > LOCAL_TIME_SIZE) & cell.rlike(REAL_OFFSET_TIME_PATTERN), F.lit(TIMESTAMP))
        # Within a number a dash follows an exponent's letter.
        .when(F.substring(cell, 4, 1).isin("e", "E") & real, F.lit(FLOAT64))
        .otherwise(F.lit(TEXT))
    )
    # A number without point and exponent is an integer if it fits 64 bits.
    digits = ~(F.contains(cell, F.lit(".")) | F.contains(cell, F.lit("e")) | F.contains(cell, F.lit("E")))
    figures = F.ltrim(cell, F.lit("+-0"))
    count = F.octet_length(figures)
    limit = F.when(F.startswith(cell, F.lit("-")), F.lit(_MIN_BIGINT)).otherwise(F.lit(_MAX_BIGINT))
    fits = (count < len(_MAX_BIGINT)) | (count == len(_MAX_BIGINT)) & (figures <= limit)
    whole = digits & ((size < len(_MAX_BIGINT)) | fits)
    signed = F.startswith(cell, F.lit("+")) | F.startswith(cell, F.lit("-"))
    number = (
        F.when(real, F.when(whole, F.lit(INT64)).otherwise(F.lit(FLOAT64)))
        .when(signed & cell.rlike(SIGNED_WORD_PATTERN), F.lit(FLOAT64))
        .otherwise(F.lit(TEXT))
    )
    word = F.lower(cell)
    kind = (
        F.when((cell >= "+") & (cell < ":"), F.when(F.substring(cell, 5, 1) == "-", dashed).otherwise(number))
        .when(cell.isin(*null_values), F.lit(NULL_CELL))
        .when(word.isin("true", "false"), F.lit(BOOLEAN))
        .when(word.isin(*FLOAT_WORDS), F.lit(FLOAT64))
        .otherwise(F.lit(TEXT))
    )
    # Null tokens that look like numbers must be told before the numbers.
    numeric_tokens = [token for token in null_values if "+" <= token < ":"]
    return F.when(cell.isin(*numeric_tokens), F.lit(NULL_CELL)).otherwise(kind) if numeric_tokens else kind


def type_of_mask(mask: Column) -> Column:
    """Name of the type a column gets from the OR of its cell masks."""
    return (
        F.when(mask == BOOLEAN, F.lit("boolean"))
        .when(mask == INT64, F.lit("bigint"))
        .when(mask.isin(FLOAT64, INT64 | FLOAT64), F.lit("double"))
        .when(mask == DATE, F.lit("date"))
        .when(mask.isin(TIMESTAMP, DATE | TIMESTAMP), F.lit("timestamp_ntz"))
        .otherwise(F.lit("string"))
    )


TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _offset_timestamp(cell: str) -> str:
    """SQL text: an offset timestamp moved to UTC, independent of the session zone."""
    local = f"try_cast(regexp_extract(upper({cell}), {text_literal(WRITTEN_TIME_PATTERN)}, 1) AS timestamp_ntz)"
    offset = f"regexp_extract({cell}, {text_literal(OFFSET_PATTERN)}, 1)"
    sign = f"if(startswith({offset}, '-'), -1, 1)"
    hours = f"coalesce(try_cast(substring({offset}, 2, 2) AS int), 0) * {sign}"
    minutes = f"coalesce(try_cast(substring({offset}, 5, 2) AS int), 0) * {sign}"
    return f"{local} - make_dt_interval(0, {hours}, {minutes}, 0)"


def typed_cell(cell: str, dtype: T.DataType, null_values: Sequence[str]) -> Column:
    """One trimmed cell (SQL text) as a value.

    Null tokens, and cells that do not fit the type, are null.
    """

    def like(pattern: str) -> str:
        return f"{cell} RLIKE {text_literal(pattern)}"

    words = ", ".join(text_literal(w) for w in FLOAT_WORDS)
    if isinstance(dtype, T.BooleanType):
        value = f"CASE lower({cell}) WHEN 'true' THEN true WHEN 'false' THEN false END"
    elif isinstance(dtype, T.LongType):
        value = f"CASE WHEN {like(INT_PATTERN)} THEN try_cast({cell} AS bigint) END"
    elif isinstance(dtype, T.DoubleType):
        word = f"lower(ltrim('+-', {cell}))"
        value = f"""CASE WHEN {like(FLOAT_PATTERN)} THEN try_cast({cell} AS double)
            WHEN {word} = 'nan' THEN double('nan') WHEN {word} IN ({words}) THEN try_cast({cell} AS double) END"""
    elif isinstance(dtype, T.DateType):
        value = f"CASE WHEN {like(DATE_PATTERN)} THEN try_cast({cell} AS date) END"
    elif isinstance(dtype, T.TimestampNTZType):
        value = f"""CASE WHEN {like(LOCAL_TIME_PATTERN)} OR {like(DATE_PATTERN)} THEN try_cast({cell} AS timestamp_ntz)
            WHEN {like(OFFSET_TIME_PATTERN)} THEN {_offset_timestamp(cell)} END"""
    elif isinstance(dtype, T.StringType):
        value = cell
    else:
        raise TypeError(f"no text form for {dtype.simpleString()}")
    nulls = ", ".join(text_literal(t) for t in null_values)
    present = f"CASE WHEN {cell} NOT IN ({nulls}) THEN {value} END" if nulls else value
    return F.expr(f"CAST({present} AS {dtype.simpleString()})")
