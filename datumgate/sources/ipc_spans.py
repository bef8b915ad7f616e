"""Where the record batches of Arrow IPC files lie, told from message headers alone.

A message is a prefix with the size of its metadata, the metadata, and a body whose length the metadata
states. So a walk from header to header tells where every batch begins and how many rows it
has; bodies are neither read nor decoded. Both layouts are walked alike: a file is a stream behind 8 bytes.
"""

from __future__ import annotations

import struct
from typing import Iterator, NamedTuple

import pyarrow as pa

# Fixed values of the format.
_FILE_MAGIC = b"ARROW1"
_CONTINUATION = 0xFFFFFFFF
_RECORD_BATCH = 3


class BatchPlace(NamedTuple):
    offset: int
    end: int
    rows: int


def _slot(table: bytes, at: int, field: int) -> int | None:
    """Position of a field of the flatbuffer table at ``at``, None where it has its default."""
    vtable = at - struct.unpack_from("<i", table, at)[0]
    if 4 + 2 * field >= struct.unpack_from("<H", table, vtable)[0]:
        return None
    [offset] = struct.unpack_from("<H", table, vtable + 4 + 2 * field)
    return at + offset if offset else None


def _long(table: bytes, place: int | None) -> int:
    return 0 if place is None else struct.unpack_from("<q", table, place)[0]


def _header(metadata: bytes) -> tuple[int, int, int]:
    """(kind, body length, rows) of a message; rows are those of a record batch."""
    [root] = struct.unpack_from("<I", metadata, 0)
    kind_at = _slot(metadata, root, 1)
    kind = 0 if kind_at is None else metadata[kind_at]
    rows = 0
    if kind == _RECORD_BATCH:
        header = _slot(metadata, root, 2)
        if header is None:
            raise pa.ArrowInvalid("a record batch without its header")
        rows = _long(metadata, _slot(metadata, header + struct.unpack_from("<I", metadata, header)[0], 0))
    return kind, _long(metadata, _slot(metadata, root, 3)), rows


def batch_places(source: pa.NativeFile) -> Iterator[BatchPlace]:
    """The record batches of a file or stream in order; raises ``ArrowInvalid`` where a message is broken or cut off."""
    size = source.size()
    source.seek(0)
    at = 8 if source.read(len(_FILE_MAGIC)) == _FILE_MAGIC else 0
    while at < size:
        source.seek(at)
        prefix = source.read(8)
        if len(prefix) < 4:
            raise pa.ArrowInvalid(f"message at byte {at} is cut off")
        [length] = struct.unpack_from("<I", prefix)
        start = at + 4
        if length == _CONTINUATION:
            if len(prefix) < 8:
                raise pa.ArrowInvalid(f"message at byte {at} is cut off")
            [length] = struct.unpack_from("<I", prefix, 4)
            start = at + 8
        if length == 0:
            return
        if start + length > size:
            raise pa.ArrowInvalid(f"metadata at byte {at} is cut off")
        source.seek(start)
        try:
            kind, body, rows = _header(source.read(length))
        except (struct.error, IndexError) as broken:
            raise pa.ArrowInvalid(f"metadata at byte {at} is broken: {broken}") from broken
        end = start + length + body
        if body < 0 or rows < 0 or end > size:
            raise pa.ArrowInvalid(f"body at byte {start + length} is cut off")
        if kind == _RECORD_BATCH:
            yield BatchPlace(at, end, rows)
        at = end


def stream_spans(source: pa.NativeFile, span_bytes: int) -> Iterator[tuple[int, int, int]]:
    """(byte offset, batches, rows) of runs of batches of a stream, each closed once it holds ``span_bytes``."""
    offset, first, batches, rows = None, 0, 0, 0
    for place in batch_places(source):
        if offset is None:
            offset, first, batches, rows = place.offset, place.offset, 0, 0
        batches, rows = batches + 1, rows + place.rows
        if place.end - first >= span_bytes:
            yield offset, batches, rows
            offset = None
    if offset is not None:
        yield offset, batches, rows
