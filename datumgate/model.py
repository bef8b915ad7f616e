"""Plain value types shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

PARQUET = "parquet"
ARROW_IPC = "arrow_ipc"
CSV = "csv"

# File extensions and leading bytes that decide a format.
EXTENSIONS = {
    PARQUET: ("parquet", "pq"),
    ARROW_IPC: ("arrow", "feather", "ipc"),
    CSV: ("csv", "tsv"),
}
MAGIC = {PARQUET: b"PAR1", ARROW_IPC: b"ARROW1"}

# Cells that count as null when types are inferred.
NULL_TOKENS = ("", "null", "NULL", "None", "NA", "N/A", "nan", "NaN")

PIPELINE_VERSION = "datumgate-ingestion-v1"


@dataclass(frozen=True)
class CsvOptions:
    """How delimited text is read.

    ``max_sample_rows=None`` infers from every line. A number restricts the
    inference to the first that many non-blank lines of each file, the header
    line included.
    """

    delimiter: str = ","
    has_header: bool = True
    null_values: tuple[str, ...] = NULL_TOKENS
    max_sample_rows: int | None = None


@dataclass(frozen=True)
class IngestionSource:
    name: str
    source_path: str
    format_hint: str | None = None
    csv: CsvOptions | None = None


@dataclass(frozen=True)
class IngestionOptions:
    """``strict_schema`` refuses a known name that arrives with another schema.

    ``verify`` decodes every file, which finds broken data behind a sound footer.
    """

    strict_schema: bool = True
    max_bytes: int | None = None
    sample_limit: int | None = None
    verify: bool = False


@dataclass(frozen=True)
class MinRowCount:
    minimum: int


@dataclass(frozen=True)
class MaxNullPercentage:
    column: str
    max_allowed: float


@dataclass(frozen=True)
class NonEmptyColumn:
    column: str


QualityRule = MinRowCount | MaxNullPercentage | NonEmptyColumn
