"""N-gram Jaccard join with Bayesian pruning of candidates, without pair rows.

Texts with equal words are one *content*; contents are compared by their sets of
``SHINGLE_WORDS``-word shingles. Contents that share a band of MinHash values are
candidates. Every content of a shared bucket gets a home (the least leader of its
buckets, then of those that share a bucket with these, ``HOME_ROUNDS`` times over, so that a group of
near copies has one home or few) and homes are cut into blocks; two blocks are compared
when a bucket has members in both. Within a pair of blocks, each pair of contents that shares a band
has its MinHash values compared in steps; it is dropped once the posterior
probability of reaching the threshold falls below ``TOLERANCE``, and what remains
is verified on the whole shingle sets. A content pair meets in one pair of
blocks only, so links add up; a pair of blocks emits one row per
content with its number of links and its root in a spanning forest. Large groups
of near copies therefore cost no pair rows and no cap.

A home has up to ``HOME_BLOCKS`` blocks, so a content is sent to as many tasks at most, however large its
home, until blocks reach ``MOST_CONTENTS`` contents or ``MOST_SHINGLES`` shingles, what a task holds.
Only homes beyond ``HOME_BLOCKS`` such blocks (65,536 contents that are no exact copies) have more, and
send each content to more tasks; the number of links is exact there too. Tasks compare their blocks in
tiles, so the pairs in memory are bounded.

Defined results: the class of a document is the least doc_id of its connected group of links;
a text without words (null, empty) has no shingles and links to nothing, its
class is its own id; a text of 1 to 4 words has one shingle, all its words. Rows
equal in words count as linked documents of one class, repeated rows
included. A null id counts as the least one. Contents are told apart by 64-bit
hashes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bitmap_of, in_bitmap, packed, tidy, unpacked, written
from .words import U, mix, random_numbers, shingles, text_slices, words_of

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_VALUES = 32, 4  # a pair of similarity 0.8 shares no band with probability 5e-8
HASHES = BANDS * BAND_VALUES
STEP = 16
TOLERANCE = 1e-6
HOME_ROUNDS = 2
BLOCK_CONTENTS = 256
BLOCK_SHINGLES = 400_000
HOME_BLOCKS = 8
MOST_CONTENTS = 8192
MOST_SHINGLES = 4_000_000
TILE = 512
SALTS = 8
NO_ID = -(2**63)
_FACTORS = random_numbers(HASHES, 101) | U(1)
_SHIFTS = random_numbers(HASHES, 202)
_BAND_SEEDS = random_numbers(BANDS, 303)


def fewest_matches(threshold: float, tolerance: float) -> list[int]:
    """For n compared values, the fewest matches with P(similarity >= threshold) >= tolerance.

    With a uniform prior, m matches of n give the posterior Beta(m + 1, n - m + 1),
    whose upper tail is the chance of at most m successes in n + 1 trials.
    """
    out = [0]
    for n in range(1, HASHES + 1):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def signatures(shingle: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values of each text that has shingles."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), HASHES), np.uint32)
    if len(starts):
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                values = ((shingle * _FACTORS[k] + _SHIFTS[k]) >> U(32)).astype(np.uint32)
                out[:, k] = np.minimum.reduceat(values, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    with np.errstate(over="ignore"):
        parts = signature.reshape(len(signature), BANDS, BAND_VALUES).astype(np.uint64)
        key = np.broadcast_to(_BAND_SEEDS, parts.shape[:2]).copy()
        for k in range(BAND_VALUES):
            key = mix(key + parts[:, :, k])
    return key


def _contents(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of each text's sequence of words."""
    counts = np.diff(bounds)
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(bounds[:-1], counts).astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + mix(place + U(7))))))
        return mix(sums[bounds[1:]] - sums[bounds[:-1]] + counts.astype(np.uint64))


def _row_key(ids: np.ndarray, contents: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(contents + mix(ids.view(np.uint64) + U(3)))


def _read(batch: pa.RecordBatch):
    """(ids, text hashes and so on) of each slice of a batch."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for first, after, data, offsets in text_slices(batch.column(1)):
        hashes, _, _, bounds = words_of(data, offsets)
        yield ids[first:after], hashes, bounds, _contents(hashes, bounds)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, content, n_shingles, bands) of every row of (doc_id, text, text_hash)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, hashes, bounds, contents in _read(batch):
                shingle, cuts = shingles(hashes, bounds, SHINGLE_WORDS)
                sizes = np.diff(cuts)
                text_hash, done = batch.column(2).slice(done, len(ids)), done + len(ids)
                keys = band_keys(signatures(shingle, cuts)).astype("<u8")
                row = iter(keys)
                bands = [next(row).tobytes() if n else None for n in sizes]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids),
                        text_hash,
                        pa.array(contents.view(np.int64)),
                        pa.array(sizes),
                        pa.array(bands, pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "content", "n_shingles", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, text_hash long, content long, n_shingles long, bands binary")


def bucket_rows(reps: DataFrame) -> DataFrame:
    """(bucket, content), one row per band."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
            owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owner)], names=["bucket", "content"])

    return reps.select("content", "bands").mapInArrow(run, "bucket long, content long")


def homes_of(members: DataFrame) -> DataFrame:
    """(content, home): the least leader within ``HOME_ROUNDS`` steps from bucket to bucket."""
    homes = members.groupBy("content").agg(F.min("leader").alias("home"))
    held = members.select("bucket", "content")
    for _ in range(HOME_ROUNDS):
        near = held.join(homes, "content").groupBy("bucket").agg(F.min("home").alias("home"))
        homes = written(held.join(near, "bucket").groupBy("content").agg(F.min("home").alias("home")), "join-homes")
    return homes


def blocks_of(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(content, block): contents of one home, in blocks of bounded size."""
    homes = homes_of(members).join(reps.select("content", "n_shingles"), "content")
    sizes = homes.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    wanted = F.ceil(F.greatest(F.col("n") / BLOCK_CONTENTS, F.col("weight") / BLOCK_SHINGLES))
    needed = F.ceil(F.greatest(F.col("n") / MOST_CONTENTS, F.col("weight") / MOST_SHINGLES))
    parts = F.greatest(F.least(wanted, F.lit(HOME_BLOCKS)), needed)
    part = F.pmod(F.xxhash64("content"), F.col("parts"))
    return homes.join(sizes.select("home", parts.alias("parts")), "home").select("content", F.xxhash64("home", part).alias("block"))


def block_pairs(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """(low, high): the pairs of blocks that share a bucket, and each block with itself."""
    seen = members.select("bucket", "content").join(blocks, "content").select("bucket", "block").distinct()
    several = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    shared = seen.join(several, "bucket")
    other = shared.select("bucket", F.col("block").alias("high"))
    across = shared.withColumnRenamed("block", "low").join(other, "bucket").where("low < high").select("low", "high").distinct()
    return blocks.select(F.col("block").alias("low"), F.col("block").alias("high")).distinct().unionByName(across)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(content, shingles, values) of the rows of ``wanted`` (content, doc_id), one per content."""
    ids = wanted.select(F.col("doc_id"), F.col("content"))

    @tidy
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _row_key(*(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(t) for k, t in ((0, np.int64), (1, np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    shared = docs.sparkSession.sparkContext.broadcast(packed(bitmap_of(ids.mapInArrow(keys, "key long"))))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = unpacked(shared.value)
        for batch in batches:
            for own, hashes, bounds, contents in _read(batch):
                pick = in_bitmap(bitmap, _row_key(own, contents)) & (np.diff(bounds) > 0)
                if not pick.any():
                    continue
                shingle, cuts = shingles(hashes, bounds, SHINGLE_WORDS)
                chosen = np.flatnonzero(pick)
                parts = [shingle[cuts[t] : cuts[t + 1]] for t in chosen]
                sets = [np.unique(p) for p in parts]
                bounds_of = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                values = signatures(np.concatenate(sets), bounds_of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(contents[chosen].view(np.int64)),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                        pa.array([v.tobytes() for v in values], pa.binary()),
                    ],
                    names=["content", "shingles", "minhash"],
                )

    found = docs.mapInArrow(run, "content long, shingles binary, minhash binary")
    return found.join(wanted.select("content"), "content", "left_semi").dropDuplicates(["content"])


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs."""
    if len(left) <= 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = n > 1
    number = np.cumsum(common) - 1
    inside = common[column]
    owners, column = owners[inside], number[column[inside]]
    order = np.argsort(column, kind="stable")
    owners, column = owners[order], column[order]
    total, width = np.zeros((len(sets), len(sets)), np.float64), 4096
    for low in range(0, int(common.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[owners[a:b], column[a:b] - low] = 1
        total += matrix @ matrix.T
    return total[left, right].astype(np.int64)


def linked_pairs(values: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float):
    """The pairs that share a band, survive the pruning and reach the threshold exactly."""
    keys = band_keys(values)
    near = np.concatenate([(keys[left[k : k + 8192]] == keys[right[k : k + 8192]]).any(1) for k in range(0, len(left), 8192)] or [np.zeros(0, bool)])
    left, right = left[near], right[near]
    needed, matches = fewest_matches(threshold, tolerance), np.zeros(len(left), np.int64)
    for low in range(0, HASHES, STEP):
        matches += (values[left, low : low + STEP] == values[right, low : low + STEP]).sum(1)
        alive = matches >= needed[low + STEP]
        left, right, matches = left[alive], right[alive], matches[alive]
    sizes = np.array([len(s) for s in sets], np.int64)
    common = _intersections(sets, left, right)
    ok = common >= threshold * (sizes[left] + sizes[right] - common) - 1e-9
    return left[ok], right[ok]


def _joined(roots: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index of each index's group, after the groups of the given pairs are joined."""
    count = len(roots)
    pairs = np.unique(np.minimum(roots[left], roots[right]) * count + np.maximum(roots[left], roots[right]))
    parent = roots.tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pair in pairs.tolist():
        a, b = root(pair // count), root(pair % count)
        parent[max(a, b)] = min(a, b)
    return np.array([root(x) for x in range(count)], np.int64) if len(pairs) else roots


def _tiles(ours: np.ndarray, theirs: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indexes, left, right): all pairs of two lists of indexes, or within one, in tiles; left and right are places in the indexes."""
    cut = lambda x: [x[k : k + TILE] for k in range(0, len(x), TILE)]
    mine = cut(ours)
    for k, a in enumerate(mine):
        if theirs is None:
            yield a, *np.triu_indices(len(a), 1)
        for b in mine[k + 1 :] if theirs is None else cut(theirs):
            places = np.arange(len(b)) + len(a)
            yield np.concatenate((a, b)), np.repeat(np.arange(len(a)), len(b)), np.tile(places, len(a))


def compare_blocks(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(content, links, root) per content and pair of blocks; ``rows`` are sorted by pair within partitions."""

    def compare(low: int, high: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        longs = lambda k: np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
        contents, block, copies = longs(2), longs(3), longs(4)
        # Views of the Arrow buffers: the sets are not copied.
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for p in parts for v in p.column(5)]
        values = np.stack([np.frombuffer(v.as_buffer(), np.uint32) for p in parts for v in p.column(6)])
        links, roots = np.zeros(len(contents), np.int64), np.arange(len(contents))
        for own, left, right in _tiles(np.flatnonzero(block == low), None if low == high else np.flatnonzero(block == high)):
            left, right = linked_pairs(values[own], [sets[i] for i in own], left, right, threshold, tolerance)
            left, right = own[left], own[right]
            np.add.at(links, left, copies[right])
            np.add.at(links, right, copies[left])
            roots = _joined(roots, left, right)
        some = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(contents[some]), pa.array(links[some]), pa.array(contents[roots[some]])],
            names=["content", "links", "root"],
        )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            pair = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            cuts = np.flatnonzero((pair[:, 1:] != pair[:, :-1]).any(0)) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a == b:
                    continue
                if key != (now := (int(pair[0, a]), int(pair[1, a]))):
                    if sum(p.num_rows for p in parts) > 1:
                        yield compare(*key, parts)
                    key, parts = now, []
                parts.append(batch.slice(a, b - a))
        if sum(p.num_rows for p in parts) > 1:
            yield compare(*key, parts)

    return rows.select("low", "high", "content", "block", "copies", "shingles", "minhash").mapInArrow(
        run, "content long, links long, root long"
    )


def components(edges: DataFrame) -> DataFrame:
    """(content, group): the least content of each connected group, by alternating large and small stars."""
    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # A star's centre may have a third of all edges: they are spread over salts.
        spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        large = salted.join(spread, ["a", "salt"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        below = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = below.groupBy("a").agg(F.min("b").alias("m"))
        spread = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = below.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        small = salted.join(spread, ["a", "salt"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = written(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = state(current)
        if after == before:
            return current.select(F.col("a").alias("content"), F.col("b").alias("group"))
        before = after


def ngram_join(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, class_id, text_id, n_links, class_key, text_hash) of every row.

    ``text_id`` is the least id of the rows with the same words; ``n_links`` counts the other
    documents of similarity ``threshold`` or more; ``class_key`` tells classes apart where
    different texts share an id.
    """
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id")
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(ids, text.alias("text"))
    rows = written(described(docs.select(ids, text.alias("text"), F.xxhash64(text).alias("text_hash"))), "join-rows")
    reps = written(
        rows.where("n_shingles > 0")
        .groupBy("content")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        ),
        "join-contents",
    )
    buckets = bucket_rows(reps)
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("leader")).where("n > 1")
    members = written(buckets.join(shared.select("bucket", "leader"), "bucket"), "join-members")
    blocks = written(blocks_of(members, reps), "join-blocks")
    pairs = block_pairs(members, blocks)
    wanted = blocks.join(reps, "content").select("content", "doc_id", "block", "copies")
    sets = shingle_sets(plain, wanted).join(wanted.drop("doc_id"), "content")
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("low", "high"))))
    rows_of_pairs = sides.join(sets, "block").repartition("low", "high").sortWithinPartitions("low", "high")
    links = written(compare_blocks(rows_of_pairs, threshold, tolerance), "join-links")
    groups = components(links.select(F.col("content").alias("a"), F.col("root").alias("b")))
    grouped = reps.join(groups, "content", "left").withColumn("group", F.coalesce("group", "content"))
    classes = grouped.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    counted = links.groupBy("content").agg(F.sum("links").alias("links"))
    known = (
        grouped.join(classes, "group")
        .join(counted, "content", "left")
        .select(
            "content",
            "class_id",
            F.col("group").alias("class_key"),
            F.col("doc_id").alias("text_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    real = lambda c: F.nullif(c, F.lit(NO_ID))
    return rows.join(known, "content", "left").select(
        real(F.col("doc_id")).alias("doc_id"),
        real(F.coalesce("class_id", "doc_id")).alias("class_id"),
        real(F.coalesce("text_id", "doc_id")).alias("text_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("class_key", F.xxhash64("doc_id", "text_hash")).alias("class_key"),
        "text_hash",
    )


def one_per_class(docs: DataFrame, joined: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: the class id's, of several its text of least hash; all columns stay, whatever their names."""
    kept = (
        joined.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
        .groupBy("class_id", "class_key")
        .agg(F.min("text_hash").alias("hash"))
        .select(F.coalesce("class_id", F.lit(NO_ID)).alias("id"), "hash")
        .distinct()
    )
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"),
    )
    return rows.join(kept, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
