"""Written tables, fixed-size bitmaps and Arrow maps shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import scratch_dir
from .words import U

BatchMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
LOG2_BITS = 24  # 2 MiB, whatever the number of keys


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the folder the cluster shares; cuts the lineage."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(function: BatchMap) -> BatchMap:
    """A function for ``mapInArrow`` that leaves no freed memory behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _give_back()

    return run


def _spot(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> U(64 - LOG2_BITS)).astype(np.int64)


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the one column of 64-bit hashes; the driver gets at most 2^18 rows."""

    @tidy
    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = np.unique(_spot(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
            bits = (np.uint64(1) << (spot & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spot >> 6), pa.array(bits)], names=["word", "bits"])

    merged = keys.mapInArrow(spots, "word long, bits long").groupBy("word").agg({"bits": "bit_or"}).toPandas()
    out = np.zeros(1 << (LOG2_BITS - 6), np.uint64)
    out[merged["word"].to_numpy(np.int64)] = merged.iloc[:, 1].to_numpy(np.int64).view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return bitmap[_spot(keys)]


def packed(bitmap: np.ndarray) -> bytes:
    return np.packbits(bitmap, bitorder="little").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").view(bool)
