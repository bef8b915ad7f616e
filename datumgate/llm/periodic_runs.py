"""Maximal periodic runs of words, found by block convolutions at dyadic scales.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and length >= max(``MIN_LENGTH``, 2 * q) that no neighbouring word
extends keeping period q.

At scale L the words are cut into aligned blocks of L words. A run of period q
repeats at least max(q, ``MIN_LENGTH`` - q) of its words at distance q, and any
2 * L - 1 neighbouring words hold a whole block; so scale L finds the periods from
2 * L - 1 to 4 * L - 2 (the first scale all below its next). For each block the sums of
squared differences with all windows at these distances are computed at once: two
of the three terms are prefix sums, the third is a convolution, taken by number
theoretic transforms modulo so many primes that a sum that is zero modulo each of
them is zero. Where it is zero the block occurs again; the distance seeds an
extension to both sides, word by word.

Blocks that cannot yield anything are left out before the transform: a word of
the block does not recur within the greatest distance, or the block and its
windows lie inside a known run of a period q <= L (its occurrences there are the
multiples of q, whose stretches are that run). Both are exact.

The documents of a slice are laid one after the other, with numbers that no two of
them share, so many short texts cost as few array operations as a long one.

Defined results: a null text has no run and a null collapsed text; an empty text
or one without words has no run and an empty collapsed text. Equal rows get equal
results, null and repeated ids matter not, an empty table gives an empty result.
Columns of the table named ``runs`` or ``collapsed`` are replaced; all others
pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import tidy

MIN_LENGTH = 12
SLICE_WORDS = 1 << 15
TRANSFORM_CELLS = 1 << 18  # numbers transformed at once
# Primes c * 2^k + 1 and the root each has its powers of two from.
PRIMES = ((998244353, 3), (469762049, 3), (167772161, 3), (2013265921, 31))
SMALLEST_BLOCK = 2

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SPACES = "[\\x20\\x09-\\x0D]+"


def _powers(root: int, size: int, prime: int) -> np.ndarray:
    """root^0 .. root^(size - 1) modulo prime, by doubling."""
    out = np.ones(size, np.uint64)
    done, step = 1, root
    while done < size:
        out[done : 2 * done] = out[:done] * np.uint64(step) % np.uint64(prime)
        done, step = 2 * done, step * step % prime
    return out


def transformed(rows: np.ndarray, prime: int, generator: int, inverse: bool = False) -> np.ndarray:
    """Number theoretic transform of each row, whose length is a power of two (Stockham's order)."""
    count_rows, size = rows.shape
    p = np.uint64(prime)
    root = pow(generator, (prime - 1) // size, prime)
    twiddles = _powers(pow(root, -1, prime) if inverse else root, max(1, size // 2), prime)
    half, stride = size // 2, 1
    x = rows.reshape(count_rows, size, 1)
    while half >= 1:
        low, high = x[:, :half], x[:, half:]
        w = twiddles[::stride][:half].reshape(1, half, 1)
        out = np.empty((count_rows, half, 2, stride), np.uint64)
        total = low + high
        out[:, :, 0] = np.where(total >= p, total - p, total)
        out[:, :, 1] = (low + (p - high)) * w % p
        x = out.reshape(count_rows, half, 2 * stride)
        half, stride = half // 2, stride * 2
    x = x.reshape(count_rows, size)
    return x * np.uint64(pow(size, -1, prime)) % p if inverse else x


def _primes_for(bound: int) -> list[tuple[int, int]]:
    chosen, product = [], 1
    for prime, generator in PRIMES:
        if product > bound:
            break
        chosen.append((prime, generator))
        product *= prime
    if product <= bound:
        raise ValueError("a text has too many words for the exact transform")
    return chosen


def occurrences(ids: np.ndarray, starts: np.ndarray, size: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of every equal window ``least`` to ``most`` words on; ``ids`` are padded to its end."""
    width = most - least + size
    length = 1 << (width + size - 2).bit_length()
    largest = int(ids.max(initial=0))
    primes = _primes_for(size * largest * largest)
    squares = np.concatenate(([0], np.cumsum(ids * ids)))
    distances = np.arange(least, most + 1)
    found_starts, found_distances = [], []
    chunk = max(1, TRANSFORM_CELLS // length)
    for first in range(0, len(starts), chunk):
        at = starts[first : first + chunk]
        blocks = np.zeros((len(at), length), np.uint64)
        blocks[:, :size] = ids[at[:, None] + np.arange(size - 1, -1, -1)]
        around = np.zeros((len(at), length), np.uint64)
        around[:, :width] = ids[at[:, None] + least + np.arange(width)]
        others = at[:, None] + distances
        plain = (squares[at + size] - squares[at])[:, None] + squares[others + size] - squares[others]
        zero = np.ones(plain.shape, bool)
        for prime, generator in primes:
            p = np.uint64(prime)
            product = transformed(blocks % p, prime, generator) * transformed(around % p, prime, generator) % p
            cross = transformed(product, prime, generator, inverse=True)[:, size - 1 : size - 1 + len(distances)]
            zero &= plain.astype(np.uint64) % p == cross * np.uint64(2) % p
        row, column = np.nonzero(zero)
        found_starts.append(at[row])
        found_distances.append(distances[column])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_starts]), np.concatenate([empty, *found_distances])


def _reach(equal_length: int, compare) -> int:
    """Number of leading equal places, compared in pieces of growing size."""
    done, piece = 0, 16
    while done < equal_length:
        stop = min(equal_length, done + piece)
        same = compare(done, stop)
        if not same.all():
            return done + int(np.argmin(same))
        done, piece = stop, piece * 4
    return done


def _stretch(ids: np.ndarray, start: int, size: int, distance: int, total: int) -> tuple[int, int]:
    """The longest stretch around the block all of whose words equal those ``distance`` on: first, after the last."""
    right, left = start + size, start
    right += _reach(total - distance - right, lambda a, b: ids[right + a : right + b] == ids[right + distance + a : right + distance + b])
    left -= _reach(
        left, lambda a, b: ids[left - b : left - a][::-1] == ids[left + distance - b : left + distance - a][::-1]
    )
    return left, right


def _has_period(ids: np.ndarray, first: int, after: int, period: int) -> bool:
    return bool((ids[first : after - period] == ids[first + period : after]).all())


def _prime_factors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] * (n > 1)


def _inside_runs(first: np.ndarray, after: np.ndarray, runs: list[tuple[int, int, int]], largest: int) -> np.ndarray:
    """Which of the ranges lie in a run of a period up to ``largest``."""
    chosen = sorted((start, start + length) for start, length, period in runs if period <= largest)
    if not chosen:
        return np.zeros(len(first), bool)
    begins = np.array([c[0] for c in chosen])
    ends = np.maximum.accumulate([c[1] for c in chosen])
    place = np.searchsorted(begins, first, "right") - 1
    return (place >= 0) & (ends[np.maximum(place, 0)] >= after)


def find_runs(ids: np.ndarray, longest: int, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``ids``, positive numbers, by start, then period.

    ``longest`` bounds the length of a run; where texts are laid one after the other, no two share a number.
    """
    total = len(ids)
    order = np.argsort(ids, kind="stable")
    recurs = np.full(total, np.iinfo(np.int64).max, np.int64)
    again = ids[order[1:]] == ids[order[:-1]]
    recurs[order[:-1][again]] = (order[1:] - order[:-1])[again]
    runs: list[tuple[int, int, int]] = []
    size = SMALLEST_BLOCK
    while (least := 1 if size == SMALLEST_BLOCK else 2 * size - 1) <= longest // 2:
        most = min(4 * size - 2, longest // 2)
        starts = np.arange(0, total - size + 1, size)
        far = np.maximum.reduceat(recurs, starts) if len(starts) else recurs[:0]
        if total % size and len(starts):
            far[-1] = recurs[starts[-1] : starts[-1] + size].max()
        starts = starts[far <= most]
        starts = starts[~_inside_runs(starts, np.minimum(starts + most + size, total), runs, size)]
        padded = np.concatenate((ids, np.zeros(most + size, np.int64)))
        found, distances = occurrences(padded, starts, size, least, most)
        covered: dict[int, int] = {}
        for k in np.lexsort((found, distances)).tolist():
            start, distance = int(found[k]), int(distances[k])
            if covered.get(distance, -1) >= start + size:
                continue
            left, right = _stretch(ids, start, size, distance, total)
            covered[distance] = right
            after = right + distance
            if after - left < max(min_length, 2 * distance):
                continue
            if not any(_has_period(ids, left, after, distance // f) for f in _prime_factors(distance)):
                runs.append((left, after - left, distance))
        size *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _number(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, their numbers from 1 on (no two texts share one) and the bounds of each text.

    ``bytes.split`` cuts at the six ASCII white-space characters only.
    """
    numbers = count(1)
    words, ids = [], []
    for text in texts:
        own = [] if text is None else text.encode("utf-8", "surrogatepass").split()
        index = defaultdict(numbers.__next__)
        words.append(own)
        ids.append(np.fromiter(map(index.__getitem__, own), np.int64, len(own)))
    bounds = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
    return words, np.concatenate([np.zeros(0, np.int64), *ids]), bounds


def runs_of_texts(texts: list[str | None], min_length: int = MIN_LENGTH) -> Iterator[tuple[list[tuple[int, int, int]], bytes | None]]:
    """(runs, collapsed text in UTF-8) of each text."""
    words, ids, bounds = _number(texts)
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    longest = max((len(w) for w in words), default=0)
    for start, length, period in find_runs(ids, longest, min_length):
        owner = int(np.searchsorted(bounds, start, "right")) - 1
        found[owner].append((start - int(bounds[owner]), length, period))
    for k, (text, own) in enumerate(zip(texts, words, strict=True)):
        runs = found.get(k, [])
        if runs:
            kept = np.ones(len(own), bool)
            for start, length, period in runs:
                kept[start + period : start + length] = False
            own = [own[i] for i in np.flatnonzero(kept).tolist()]
        yield runs, None if text is None else b" ".join(own)


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts of about ``SLICE_WORDS`` words together; a longer one comes alone."""
    part, weight = [], 0
    for text in texts:
        size = len(text or "") // 6 + 1
        if part and weight + size > SLICE_WORDS:
            yield part
            part, weight = [], 0
        part.append(text)
        weight += size
    if part:
        yield part


def detect_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; words from 0) and ``collapsed``.

    ``collapsed`` is the text's words joined by one space, without those that a run
    holds after its first period.
    """
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    place = kept.index(text_col)
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in _slices(batch.column(place).to_pylist()):
                rows = list(runs_of_texts(texts, min_length))
                columns = [batch.column(k).slice(done, len(texts)) for k in range(len(kept))]
                done += len(texts)
                sizes = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
                numbers = np.array([n for r in rows for n in r[0]], np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([pa.array(numbers[:, k].copy()) for k in range(3)], fields=list(item))
                runs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans)
                collapsed = pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, runs, collapsed], names=[*kept, "runs", "collapsed"])

    fields = [docs.schema[c] for c in kept]
    extra = T.StructType.fromDDL(f"runs {RUNS}, collapsed string")
    return docs.select(*kept).mapInArrow(run, T.StructType(fields + extra.fields))


def with_planted_run(text: Column, doc_id: Column) -> Column:
    """The text, with a periodic tail in a tenth of the documents, told by their ids.

    With h = crc32 of the id's digits and g = floor(h / 10): where h % 10 is 0 and the text
    has n > 0 words, each word i >= a becomes word a + (i - a) % p, a = g % n,
    p = 1 + floor((n - a) / (3 + g % 8)). A null id plants nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    # Each name is bound as a lambda's variable, so that it is computed once and not for each word.
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def tail(w: Column, n: Column) -> Column:
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))

        def repeated(at: Column) -> Column:
            word = lambda x, i: F.when(i < at["a"], x).otherwise(F.get(w, (at["a"] + F.pmod(i - at["a"], at["p"])).cast("int")))
            return F.array_join(F.transform(w, word), " ")

        return bound(F.struct(a.alias("a"), p.alias("p")), repeated)

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.when(n > 0, tail(w, F.greatest(n, F.lit(1)))).otherwise(text)

    chosen = F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)) & text.isNotNull()
    return F.when(chosen, bound(F.filter(F.split(text, SPACES), lambda w: w != ""), planted)).otherwise(text)
