"""Error codes raised by the engine and by diagnostics rows."""

from __future__ import annotations

SCHEMA_MISMATCH = "SchemaMismatch"
UNSUPPORTED_DATA_TYPE = "UnsupportedDataType"
INVALID_FORMAT = "InvalidFormat"
CORRUPTED_BATCH = "CorruptedBatch"
DATASET_NOT_FOUND = "DatasetNotFound"
RESOURCE_LIMIT_EXCEEDED = "ResourceLimitExceeded"
IO = "Io"
CANCELLED = "Cancelled"


class EngineError(Exception):
    """Base class; ``code`` is one of the constants above."""

    code = "Internal"

    def __init__(self, message: str):
        super().__init__(message)
        self.message = message


class SchemaMismatch(EngineError):
    code = SCHEMA_MISMATCH


class UnsupportedDataType(EngineError):
    code = UNSUPPORTED_DATA_TYPE


class InvalidFormat(EngineError):
    code = INVALID_FORMAT


class CorruptedBatch(EngineError):
    code = CORRUPTED_BATCH


class DatasetNotFound(EngineError):
    code = DATASET_NOT_FOUND


class ResourceLimitExceeded(EngineError):
    code = RESOURCE_LIMIT_EXCEEDED


class SourceIoError(EngineError):
    code = IO


class Cancelled(EngineError):
    code = CANCELLED


_BY_CODE = {
    cls.code: cls
    for cls in (
        SchemaMismatch,
        UnsupportedDataType,
        InvalidFormat,
        CorruptedBatch,
        DatasetNotFound,
        ResourceLimitExceeded,
        SourceIoError,
        Cancelled,
    )
}


def error_for(code: str, message: str) -> EngineError:
    return _BY_CODE.get(code, EngineError)(message)
