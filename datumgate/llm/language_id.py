"""Language identification with bit-sliced Bloom filters of byte n-grams.

One Bloom filter per language; the filters are sliced, so the word at a position
has one bit per language, and the AND of the words at an n-gram's positions
has the bits of all languages that (may) contain it. Per text the bits are
counted by language, weighted by the information of a mask with that many bits (log2 of
languages over popcount: a gram of all languages tells nothing, one of two tells these two
from the rest), corrected for the filter's false positives, and the largest sum decides.

Training reads a bounded sample of the labelled rows: about ``sample_rows`` per
language, chosen by hash. An n-gram belongs to every language that has it ``MIN_COUNT`` times and at
a rate of ``MIN_RATE`` in the sample; ``min_share`` also asks for a share of the sum of its
rates. The driver gets at most ``POSITIONS`` rows, whatever the input.

Defined results: a null text, or one without a letter, is ``und`` with score 0. A
text with letters but no n-gram that tells languages apart gets the first language name with score 0, as
ties do. Repeated rows are judged alike; empty tables give empty
results. With no labelled rows all texts are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import free_names
from .scratch import tidy
from .words import U, mix, text_slices

UNKNOWN = "und"
SIZES = (2, 3, 4)
HASHES = 3
POSITIONS = 1 << 18
MAX_LANGUAGES = 63
SAMPLE_ROWS = 4_000
MIN_COUNT = 3
MIN_RATE = 3e-5
MIN_SHARE = 0.0
WEIGHT_UNIT = 1 << 16
_SPACE = 0x20


def _letters() -> np.ndarray:
    """Lower-cased ASCII letters and non-ASCII bytes; anything else is a space."""
    table = np.full(256, _SPACE, np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


LETTERS = _letters()


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    slices: np.ndarray  # one mask of languages per position
    false_rate: np.ndarray  # chance that an absent n-gram looks present, per language


def _prepared(texts: pa.Array) -> pa.Array:
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    space = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(space, lowered, space, pa.scalar("", pa.large_string()))


def _prepared_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As ``text_slices``, of lower-cased texts between spaces; only one slice is copied at a time."""
    for first, after, _, _ in text_slices(texts):
        for low, high, data, offsets in text_slices(_prepared(texts.slice(first, after - first)), 1 << 62):
            yield first + low, first + high, data, offsets


def _grams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, the n-gram from each byte on as an integer that also holds the size."""
    code = LETTERS[data].astype(np.uint64)
    value = code[: len(code)]
    for size in range(2, max(SIZES) + 1):
        value = (value[: max(0, len(code) - size + 1)] << U(8)) | code[size - 1 :]
        if size in SIZES:
            yield size, value | (U(size) << U(56))


def _positions(grams: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix(grams * U(0x9E3779B97F4A7C15))
    return [((h >> U(20 * k)) & U(POSITIONS - 1)).astype(np.int64) for k in range(HASHES)]


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _window_bounds(offsets: np.ndarray, size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one window of each text; windows across texts are left out."""
    starts = np.minimum(offsets[:-1], count)
    return starts, np.maximum(np.minimum(offsets[1:] - size + 1, count), starts)


def labelled_sample(docs: DataFrame, rows: int, id_col: str, lang_col: str) -> DataFrame:
    """About ``rows`` rows per language, chosen by a hash of the id; smaller languages whole."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1)
    share = {r[lang_col]: min(1.0, rows / r["n"]) for r in sizes.collect()}
    if len(share) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not share:
        return labelled.limit(0)
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1_000_000)) / 1_000_000
    rule: Column = F.lit(False)
    for language, part in share.items():
        rule = rule | ((F.col(lang_col) == language) & (at < part))
    return labelled.where(rule)


def gram_counts(sample: DataFrame, lang_col: str) -> DataFrame:
    """(lang, gram, n): occurrences of each n-gram in each language of the sample."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for first, after, data, offsets in _prepared_slices(batch.column(0)):
                for size, grams in _grams(data):
                    starts, ends = _window_bounds(offsets, size, len(grams))
                    owner = np.full(len(grams), -1, np.int64)
                    names, number = np.unique(langs[first:after].astype(str), return_inverse=True)
                    for t, (a, b) in enumerate(zip(starts, ends, strict=True)):
                        owner[a:b] = number[t]
                    for k, name in enumerate(names):
                        found, n = np.unique(grams[owner == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)],
                            names=["lang", "gram", "n"],
                        )

    return (
        sample.select("text", F.col(lang_col).alias("lang"))
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


def train(
    docs: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    min_share: float = MIN_SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Filters from the rows of ``docs`` that have a language."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = gram_counts(labelled_sample(plain, sample_rows, "id", "lang"), "lang")
    totals = {(r.lang, r.size): r.n for r in counts.groupBy("lang", F.shiftright("gram", 56).alias("size")).agg(F.sum("n").alias("n")).collect()}
    languages = tuple(sorted({lang for lang, _ in totals}))
    if not languages:
        return LanguageModel((), np.zeros(POSITIONS, np.int64), np.zeros(0))
    number = {lang: k for k, lang in enumerate(languages)}
    spark = docs.sparkSession
    known = spark.createDataFrame(
        [(lang, size, float(n), 1 << number[lang]) for (lang, size), n in totals.items()],
        "lang string, size long, total double, bit long",
    )
    rated = counts.withColumn("size", F.shiftright("gram", 56).cast("long")).join(F.broadcast(known), ["lang", "size"])
    rated = rated.withColumn("rate", F.col("n") / F.col("total"))
    owners = (
        rated.groupBy("gram")
        .agg(F.sum("rate").alias("sum"), F.collect_list(F.struct("rate", "n", "bit")).alias("each"))
        .select(
            "gram",
            F.aggregate(
                F.filter(
                    "each",
                    lambda x: (x["rate"] >= min_share * F.col("sum")) & (x["n"] >= MIN_COUNT) & (x["rate"] >= MIN_RATE),
                ),
                F.lit(0).cast("long"),
                lambda a, x: a.bitwiseOR(x["bit"]),
            ).alias("mask"),
        )
        .where("mask <> 0")
    )

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for p in _positions(grams):
                yield pa.RecordBatch.from_arrays([pa.array(p), batch.column(1)], names=["position", "mask"])

    placed = owners.mapInArrow(place, "position long, mask long").groupBy("position").agg(F.bit_or("mask").alias("mask"))
    slices = np.zeros(POSITIONS, np.int64)
    for r in placed.toLocalIterator():
        slices[r.position] = r.mask
    fill = np.array([((slices >> k) & 1).mean() for k in range(len(languages))])
    return LanguageModel(languages, slices, fill**HASHES)


def popcount_weights(languages: int) -> np.ndarray:
    """Whole weights of masks with 0, 1, ... bits; with one language, each of its grams counts 1."""
    bits = np.arange(1, languages + 2)
    weights = np.maximum(0, np.log2(languages / bits)) if languages > 1 else (bits == 1).astype(float)
    return np.concatenate(([0], np.round(weights * WEIGHT_UNIT))).astype(np.int64)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns in ``keep`` (all by default), lang_pred and score of every row.

    The score is the winner's share of the corrected sums. Columns of ``docs``
    with the names of the two new ones, in any case, are replaced.
    """
    languages = model.languages
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    weights = popcount_weights(len(languages))
    narrow = np.uint8 if len(languages) <= 8 else np.int64
    shared = docs.sparkSession.sparkContext.broadcast((model.slices.astype(narrow), model.false_rate))

    @tidy
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, false_rate = shared.value
        for batch in batches:
            raw = batch.column(len(keep))
            hits, absent = (np.zeros((len(raw), max(1, len(languages)))) for _ in range(2))
            letters = np.zeros(len(raw), bool)
            for first, after, data, offsets in _prepared_slices(raw):
                ascii_letter = np.concatenate(([0], np.cumsum((LETTERS[data] != _SPACE) & (data < 0x80))))
                letters[first:after] = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                if not languages:
                    continue
                for size, grams in _grams(data):
                    starts, ends = _window_bounds(offsets, size, len(grams))
                    found = slices[_positions(grams)[0]]
                    for p in _positions(grams)[1:]:
                        found = found & slices[p]
                    bits = np.bitwise_count(found)
                    weight, with_one_more = weights[bits], weights[bits + 1]
                    for k in range(len(languages)):
                        there = ((found >> k) & 1).astype(bool)
                        for into, each in ((hits, np.where(there, weight, 0)), (absent, np.where(there, 0, with_one_more))):
                            sums = np.concatenate(([0], np.cumsum(each)))
                            into[first:after, k] += sums[ends] - sums[starts]
            for i in np.flatnonzero(~letters):
                letters[i] = _has_letter(raw[i].as_py())
            predicted, score = [UNKNOWN] * len(raw), np.zeros(len(raw))
            if languages:
                # A false bit adds the weight of a mask with one more; grams without the bit tell how much that is.
                corrected = np.maximum(0, hits - absent * false_rate / np.maximum(1e-9, 1 - false_rate))
                best, sums = corrected.argmax(1), corrected.sum(1)
                top = corrected[np.arange(len(raw)), best]
                score = np.where(letters & (sums > 0), top / np.maximum(sums, 1e-300), 0.0)
                predicted = [languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(predicted, pa.string()), pa.array(score)],
                names=[*keep, "lang_pred", "score"],
            )

    schema = T.StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")
    [text] = free_names(docs, "_text")
    return docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(judge, schema)
