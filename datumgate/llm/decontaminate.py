"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Seeds are four words in a row, and three words with up to one other word among them in the
item and up to two in the document. A copy with score 0.5 and seven equal words has three equal
words that near each other: its M equal words are at least 2 a replaced or lost word and 1 an
added one, so some three neighbours have at most one replaced or lost, or two added, among them.

The seeds of all test items are counted in the whole corpus. A seed of an item is
rare up to ``RARE_PLACES`` places, up to ``rare_rate`` of all places, and up to
``MEDIAN_FACTOR`` times the item's median seed of as many words; so every item keeps at least half of its seeds
however often it was copied, and an edited copy does not make its own seeds common. Documents emit the passages around rare seeds; a join on the seed pairs
them with items, and each pair is aligned word by word (match 2, mismatch and gap
-1). The score is the best local alignment over that of a whole copy.

Both scans of the corpus test seeds against two bitmaps of fixed size and join
the survivors exactly, so what is shuffled follows the hits, not the text.

Defined results: null and empty texts hold no passage; items of fewer words than a seed
are no evidence and are skipped; a document and an item that match in
several passages give one row, with the best score, then the first place; repeated rows and
repeated items give one row; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bitmap_of, in_bitmap, packed, tidy, unpacked, written
from .words import U, mix, text_slices, windows, words_of

SEED_WORDS = 4
MIN_SCORE = 0.5
RARE_RATE = 1e-6
RARE_PLACES = 100
MEDIAN_FACTOR = 10
#: Places of the second and third word of a seed of three, after the first.
ITEM_TRIPLES = ((1, 2), (1, 3), (2, 3))
TEXT_TRIPLES = (*ITEM_TRIPLES, (1, 4), (2, 4), (3, 4))
_STEP = 0x9E3779B97F4A7C15
LONGS = pa.list_(pa.int64())


def seed_places(hashes: np.ndarray, bounds: np.ndarray, triples: tuple[tuple[int, int], ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, seed) of the seeds of four words, then of each kind of three; the lowest bit tells them apart."""
    window, valid = windows(hashes, bounds, SEED_WORDS)
    at = np.flatnonzero(valid)
    yield at, (window[at] & ~U(1)).view(np.int64)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(hashes))
    with np.errstate(over="ignore"):
        first = hashes * U(_STEP)
        for second, third in triples:
            at = np.flatnonzero(left > third)
            yield at, (mix((first[at] + hashes[at + second]) * U(_STEP) + hashes[at + third]) | U(1)).view(np.int64)


def seed_bitmaps(seeds: DataFrame) -> tuple[bytes, bytes]:
    """Bitmaps of two parts of the seeds' bits."""
    return packed(bitmap_of(seeds)), packed(bitmap_of(seeds.select(F.shiftleft("seed", 24))))


def in_both(bitmaps: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """Numbers of the seeds that are in both bitmaps."""
    some = np.flatnonzero(in_bitmap(bitmaps[0], seeds))
    return some[in_bitmap(bitmaps[1], seeds[some] << 24)]


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words, seeds): word hashes and seeds of each item."""
    kind = items.schema[id_col].dataType.simpleString()

    @tidy
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, seeds = [], []
            for _, _, data, offsets in text_slices(batch.column(1)):
                hashes, _, _, bounds = words_of(data, offsets)
                places = list(seed_places(hashes, bounds, ITEM_TRIPLES))
                for a, b in zip(bounds, bounds[1:], strict=False):
                    words.append(hashes[a:b].view(np.int64))
                    seeds.append(np.unique(np.concatenate([x[slice(*np.searchsorted(at, (a, b)))] for at, x in places])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, LONGS), pa.array(seeds, LONGS)], names=["item_id", "words", "seeds"]
            )

    split_items = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    return split_items.mapInArrow(split, f"item_id {kind}, words array<long>, seeds array<long>").where(F.size("words") >= SEED_WORDS)


def seed_counts(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, n): places of each seed in the corpus, and one row (null, n) with the number of all places."""
    shared = docs.sparkSession.sparkContext.broadcast(seed_bitmaps(seeds))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [unpacked(b) for b in shared.value]
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                hashes, _, _, bounds = words_of(data, offsets)
                met, places = [], 0
                for at, seeds in seed_places(hashes, bounds, TEXT_TRIPLES):
                    met.append(seeds[in_both(bitmaps, seeds)])
                    places = places or len(at)
                found, n = np.unique(np.concatenate(met), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*found.tolist(), None], pa.int64()), pa.array([*n.tolist(), places], pa.int64())],
                    names=["seed", "n"],
                )

    return docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


def rare_seeds(items: DataFrame, counts: DataFrame, rare_rate: float) -> DataFrame:
    """(seed, item_id) of the seeds kept."""
    each = items.select("item_id", F.explode("seeds").alias("seed")).distinct()
    places = counts.where("seed is null").select((F.col("n") * rare_rate).alias("limit"))
    known = each.join(counts.where("seed is not null"), "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    known = known.withColumn("kind", F.col("seed").bitwiseAND(1))
    medians = known.groupBy("item_id", "kind").agg(F.percentile_approx("n", 0.5, 1000).alias("median"))
    limit = places.first()
    common = max(RARE_PLACES, float(limit["limit"]) if limit else 0.0)
    bound = F.greatest(MEDIAN_FACTOR * F.col("median"), F.lit(float(common)))
    same = F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("kind") == F.col("_kind"))
    return known.join(medians.withColumnsRenamed({"item_id": "_item", "kind": "_kind"}), same).where(
        F.col("n") <= bound
    ).select("seed", "item_id")


def passages(docs: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """(doc_id, start, words, seeds): word hashes ``reach`` words around rare seeds, overlaps merged."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(seed_bitmaps(seeds.select("seed")))

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [unpacked(b) for b in shared.value]
        for batch in batches:
            for first, _, data, offsets in text_slices(batch.column(1)):
                hashes, _, _, bounds = words_of(data, offsets)
                places = [(at[some], x[some]) for at, x in seed_places(hashes, bounds, TEXT_TRIPLES) for some in (in_both(bitmaps, x),)]
                hits, met = (np.concatenate(part) for part in zip(*places, strict=True))
                if not len(hits):
                    continue
                order = np.argsort(hits, kind="stable")
                hits, met = hits[order], met[order]
                owner = np.searchsorted(bounds, hits, "right") - 1
                new = np.concatenate(([True], (np.diff(hits) > 2 * reach) | (np.diff(owner) > 0)))
                heads = np.flatnonzero(new)
                tails = np.concatenate((heads[1:], [len(hits)]))
                rows, starts, words, found = [], [], [], []
                for a, b in zip(heads, tails, strict=True):
                    t = owner[a]
                    low = max(bounds[t], hits[a] - reach)
                    high = min(bounds[t + 1], hits[b - 1] + SEED_WORDS + 1 + reach)
                    rows.append(first + int(t))
                    starts.append(int(low - bounds[t]))
                    words.append(hashes[low:high].view(np.int64))
                    found.append(np.unique(met[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(starts, pa.int64()), pa.array(words, LONGS), pa.array(found, LONGS)],
                    names=["doc_id", "start", "words", "seeds"],
                )

    return docs.mapInArrow(cut, f"doc_id {kind}, start long, words array<long>, seeds array<long>")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local score, and the passage word after its end (the first such)."""
    place = np.arange(1, len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        here = np.maximum(row[:-1] + np.where(passage == word, 2, -1), row[1:] - 1)
        here = np.maximum(here, 0) + place
        # A gap in the passage costs 1 a word: a running maximum along the row.
        row = np.concatenate(([0], np.maximum(np.maximum.accumulate(here) - place, 0)))
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
    return best, end


def scored(pairs: DataFrame, min_score: float) -> DataFrame:
    """Aligns (doc_id, start, words, item_id, item) rows, each on its own."""
    doc_kind, item_kind = (pairs.schema[c].dataType.simpleString() for c in ("doc_id", "item_id"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, scores, firsts, lasts = [], [], [], []
            for i in range(batch.num_rows):
                words = batch.column(2)[i].values.to_numpy()
                item = batch.column(4)[i].values.to_numpy()
                # Equal words count 2 at most, so fewer of them cannot reach the score.
                if np.isin(item, words).sum() < min_score * len(item):
                    continue
                best, end = align(item, words)
                score = best / (2 * len(item))
                if score >= min_score:
                    _, back = align(item[::-1], words[:end][::-1])
                    start = batch.column(1)[i].as_py()
                    keep.append(i)
                    scores.append(score)
                    firsts.append(start + end - back)
                    lasts.append(start + end)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(3).take(rows), pa.array(scores, pa.float64()), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64())],
                names=["doc_id", "item_id", "score", "start_word", "end_word"],
            )

    return pairs.select("doc_id", "start", "words", "item_id", "item").mapInArrow(
        run, f"doc_id {doc_kind}, item_id {item_kind}, score double, start_word long, end_word long"
    )


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    min_score: float = MIN_SCORE,
    rare_rate: float = RARE_RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of each document that holds a copy of an item."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tests = written(item_words(items, item_id_col, item_text_col), "leak-items")
    longest = tests.agg(F.coalesce(F.max(F.size("words")), F.lit(0)).alias("n")).first().n
    counts = written(seed_counts(plain, tests.select(F.explode("seeds").alias("seed"))), "leak-counts")
    seeds = written(rare_seeds(tests, counts, rare_rate), "leak-seeds")
    found = written(passages(plain, seeds, longest), "leak-passages").withColumn("passage", F.xxhash64("doc_id", "start", "words"))
    met = (
        found.select("passage", F.explode("seeds").alias("seed"))
        .join(seeds, "seed")
        .select("passage", "item_id")
        .distinct()
    )
    pairs = (
        met.join(found.select("passage", "doc_id", "start", "words"), "passage")
        .join(tests.select(F.col("item_id").alias("_item"), F.col("words").alias("item")), F.col("item_id").eqNullSafe(F.col("_item")))
        .select("doc_id", "start", "words", "item_id", "item")
    )
    return (
        scored(pairs, min_score)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("score", (-F.col("start_word")).alias("before"), "end_word")).alias("best"))
        .select("doc_id", "item_id", "best.score", (-F.col("best.before")).alias("start_word"), "best.end_word")
    )


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents that hold no copy of an item, with all their columns.

    A document is told by its id and its text together: other texts under the id of one that
    leaks, a null one included, stay.
    """
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    leaks = find_leaks(docs.select(key.alias("doc_id"), F.col(text_col).alias("text")), items, **options)
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    bad = leaks.select(F.col("doc_id").alias("key")).distinct()
    return rows.join(bad, "key", "left_anti").select("row.*")
