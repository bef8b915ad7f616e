"""Words, hashes and shingles of whole Arrow batches, vectorised with NumPy.

A word is a run of ASCII letters, digits and non-ASCII characters; A-Z are
lower-cased. Equal words have equal 64-bit hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BASE, _BASE_INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def random_numbers(count: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=np.uint64) * U(_STEP) + U(seed))


def _lowered() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


LOWERED = _lowered()
_BYTE_VALUES = random_numbers(256, 11)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(_BASE_INVERSE)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets) of about ``most`` bytes each; a longer text comes alone."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        after = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        after = min(max(after, first + 1), len(texts))
        low, high = offsets[first], offsets[after]
        yield first, after, data[low:high], offsets[first : after + 1] - low
        first = after


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word, and the word bounds of each text."""
    low = LOWERED[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = low != 0
    before, after = inside[:-2].copy(), inside[2:].copy()
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    word = inside[1:-1]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    size = 1 << max(19, int(len(data)).bit_length())
    powers, inverses = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_VALUES[low] * powers[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * U(_STEP))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each position on, and whether they are in one text."""
    count = len(hashes)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out[: max(0, count - k)] = out[: max(0, count - k)] * U(_STEP) + hashes[k:]
        out = mix(out + U(size))
    valid = np.zeros(count, bool)
    if count >= size:
        valid[: count - size + 1] = True
    for k in range(1, size):
        cut = bounds[1:] - k
        cut = cut[(cut >= 0) & (cut < count)]
        valid[cut] = False
    return out, valid


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of all texts, one after the other, and the bounds of each text.

    A text of fewer than ``size`` words has one shingle, all its words; a text
    without words has none.
    """
    window, valid = windows(hashes, bounds, size)
    counts = np.diff(bounds)
    with np.errstate(over="ignore"):
        for t in np.flatnonzero((counts > 0) & (counts < size)):
            value = U(0)
            for h in hashes[bounds[t] : bounds[t + 1]]:
                value = value * U(_STEP) + h
            window[bounds[t]] = mix(np.array([value + U(counts[t])], np.uint64))[0]
            valid[bounds[t]] = True
    return window[valid], np.concatenate(([0], np.cumsum(valid)))[bounds]
