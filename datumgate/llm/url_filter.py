"""URL filter: blocked Bloom filter first, exact hash join after.

A list holds (host, path, verdict) entries, and in a column ``kind`` whether each is a
``rule`` (a path prefix that ends with ``/``, for its host and all subdomains) or one listed
canonical URL (``exact``). Only where no kind is stated, a path that ends with ``/`` is taken
for a rule. A URL could be listed under each of its host suffixes with each of its path prefixes that
ends at a ``/``, and under its canonical form. These keys are never written out: host suffixes and path prefixes are
hashed step by step, a suffix that no rule has is dropped first, and prefixes deeper than every rule are not looked at. Only keys
that pass the filter become text; an exact join on it removes the false positives; the longest rule wins, and a listed
URL counts before any rule.

The filter has 16 bits for each entry up to ``MAX_BLOCKS``; a longer list passes more keys to the exact join.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits nothing and is allowed. Rows with equal URLs get equal verdicts. Listed
entries with equal host and path: ``block`` wins. An empty list allows all. Other columns of the pages pass through, whatever
their names; a URL of any length costs time and memory in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import free_names

ALLOW, BLOCK = "allow", "block"
RULE, EXACT = "rule", "exact"
WORDS = 8  # 64-bit words of a block: 512 bits, one cache line
MIN_BLOCKS, MAX_BLOCKS = 1 << 10, 1 << 18  # 64 KiB to 16 MiB
BITS_PER_ENTRY = 16
PROBES = 8
HASHES_AT_ONCE = 1 << 14
BROADCAST_ENTRIES = 50_000
MAX_ENTRY_BYTES = 2_048
SALTS = 16


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def path_of_url(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.`` and default port, path, sorted query without tracking, no fragment."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.rtrim(path_of_url(url), F.lit("/"))
    query = F.coalesce(F.regexp_extract(url, r"^(?s)[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))
    joined = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def suffix_hashes(host: str) -> list[int]:
    """Hashes of the host's last label, its last two, and so on to the whole host."""
    running, out = xxhash.xxh64(), []
    for label in reversed(host.split(".")):
        running.update(label.encode() + b".")
        out.append(running.intdigest())
    return out


def prefix_hashes(path: str, deepest: int) -> list[int]:
    """Hashes of the path's prefixes that end at its first ``/``, its second, and so on to the ``deepest``."""
    running, out = xxhash.xxh64(seed=1), []
    for part in path.split("/", deepest)[:-1]:
        running.update(part.encode() + b"/")
        out.append(running.intdigest())
    return out


def _pair_hashes(host: int, paths: list[int]) -> np.ndarray:
    mixed = (np.array(paths, np.uint64) ^ np.uint64(host)) * np.uint64(0xFF51AFD7ED558CCD)
    return (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(host)


def _exact_hash(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode(), seed=2)


def listed_entries(listed: DataFrame) -> DataFrame:
    """(key, kind, verdict), one row per key."""
    kind = F.when(F.col("path").endswith("/"), RULE).otherwise(EXACT)
    if "kind" in listed.columns:
        kind = F.coalesce("kind", kind)
    key = F.concat(_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit("")))
    return (
        listed.select(key.alias("key"), kind.alias("kind"), F.col("verdict"))
        .groupBy("key", "kind")
        .agg(F.max("verdict").alias("verdict"))
    )


def blocks_for(entries: int) -> int:
    """A power of two: 16 bits for each of the two hashes an entry may have, within bounds."""
    wanted = max(1, -(-2 * entries * BITS_PER_ENTRY // (64 * WORDS)))
    return min(MAX_BLOCKS, max(MIN_BLOCKS, 1 << (wanted - 1).bit_length()))


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and the bits to set or test in its words."""
    h = hashes.astype(np.uint64)
    block = (h >> np.uint64(40)) % np.uint64(blocks)
    masks = np.zeros((len(h), WORDS), np.uint64)
    rows = np.arange(len(h))
    x = h
    for _ in range(PROBES):
        x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        bit = x >> np.uint64(55)  # 0 to 511
        masks[rows, bit >> np.uint64(6)] |= np.uint64(1) << (bit & np.uint64(63))
    return block.astype(np.int64), masks


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, masks = _bits(hashes, len(table))
    return ((table[block] & masks) == masks).all(axis=1)


def entry_hashes(keys: Iterable[str], kinds: Iterable[str]) -> np.ndarray:
    """What the filter holds: of a listed URL its hash, of a rule that of its host and that of host and path."""
    out: list[int] = []
    for key, kind in zip(keys, kinds, strict=True):
        if kind == EXACT:
            out.append(_exact_hash(key))
            continue
        host, slash, path = key.partition("/")
        if slash and key.endswith("/"):
            whole = suffix_hashes(host)[-1]
            out.append(whole)
            out.append(int(_pair_hashes(whole, prefix_hashes(slash + path, len(key))[-1:])[0]))
    return np.array(out, np.uint64)


def build_filter(entries: DataFrame, blocks: int) -> np.ndarray:
    """The filter's words; the driver gets at most one row per block."""

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block, masks = _bits(entry_hashes(batch["key"], batch["kind"]), blocks)
            out = pd.DataFrame(masks.view(np.int64), columns=[f"w{i}" for i in range(WORDS)])
            out.insert(0, "block", block)
            yield out

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(WORDS))
    merged = (
        entries.select("key", "kind")
        .mapInPandas(set_bits, schema)
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
        .toPandas()
    )
    table = np.zeros((blocks, WORDS), np.uint64)
    table[merged["block"].to_numpy()] = merged.drop(columns="block").to_numpy(np.int64).view(np.uint64)
    return table


def _flat(groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All hashes in a row, and the group of each."""
    return np.array([h for g in groups for h in g], np.uint64), np.repeat(np.arange(len(groups)), [len(g) for g in groups])


def possible_keys(hosts: list[str], paths: list[str], table: np.ndarray, deepest: int) -> Iterator[tuple[int, str]]:
    """Number of the URL and key, of all rules that the filter may hold for some URLs."""
    fits = [bool(h) and p.startswith("/") for h, p in zip(hosts, paths, strict=True)]
    suffixes, owner = _flat([suffix_hashes(h) if ok else [] for h, ok in zip(hosts, fits, strict=True)])
    starts = np.searchsorted(owner, np.arange(len(hosts)))
    prefixes: dict[int, list[int]] = {}
    pairs: list[tuple[int, int]] = []
    hashes: list[np.ndarray] = []
    for k in np.flatnonzero(may_hold(table, suffixes)).tolist():
        i = int(owner[k])
        if i not in prefixes:
            prefixes[i] = prefix_hashes(paths[i], deepest)
        pairs.append((i, k - int(starts[i]) + 1))
        hashes.append(_pair_hashes(int(suffixes[k]), prefixes[i]))
    if not pairs:
        return
    which = np.repeat(np.arange(len(pairs)), [len(h) for h in hashes])
    begins = np.searchsorted(which, np.arange(len(pairs)))
    for k in np.flatnonzero(may_hold(table, np.concatenate(hashes))).tolist():
        i, labels = pairs[which[k]]
        parts = paths[i].split("/", deepest)[: k - int(begins[which[k]]) + 1]
        yield i, ".".join(hosts[i].split(".")[-labels:]) + "/".join(parts) + "/"


def _runs(hosts: list[str], paths: list[str], deepest: int) -> Iterator[tuple[int, int]]:
    """Neighbouring URLs that have about ``HASHES_AT_ONCE`` hashes together."""
    first, filled = 0, 0
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        filled += (host.count(".") + 1) + min(deepest, path.count("/"))
        if filled >= HASHES_AT_ONCE:
            yield first, i + 1
            first, filled = i + 1, 0
    if first < len(hosts):
        yield first, len(hosts)


def possible_hits(split: DataFrame, table: np.ndarray, deepest: int) -> DataFrame:
    """``(url, key, kind)`` of what may be listed, from rows ``(url, host, path, canonical)``."""
    shared = split.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            urls, hosts, paths, canonical = (batch.column(i).to_pylist() for i in range(4))
            found: list[tuple[str, str, str]] = []
            listed = may_hold(words, np.array([_exact_hash(c) for c in canonical], np.uint64))
            for first, after in _runs(hosts, paths, deepest):
                keys = possible_keys(hosts[first:after], paths[first:after], words, deepest)
                found += [(urls[first + i], key, RULE) for i, key in keys]
            found += [(urls[i], canonical[i], EXACT) for i in np.flatnonzero(listed).tolist() if hosts[i]]
            columns = [pa.array([row[k] for row in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["url", "key", "kind"])

    return split.select("url", "host", "path", "canonical").mapInArrow(run, "url string, key string, kind string")


def exact_hits(possible: DataFrame, entries: DataFrame, count: int, longest: int) -> DataFrame:
    """Joins on the key; a short list is sent whole, a long one is salted against hot keys."""
    if count <= BROADCAST_ENTRIES and longest <= MAX_ENTRY_BYTES:
        return possible.join(F.broadcast(entries), ["key", "kind"])
    spread = entries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = possible.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["key", "kind", "_salt"]).drop("_salt")


def judge_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the longest that fits) and verdict.

    Where ``pages`` has columns of these names, the new ones take their place.
    """
    entries = listed_entries(listed)
    slashes = F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))
    size = entries.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max(F.octet_length("key")), F.lit(0)).alias("longest"),
        F.coalesce(F.max(F.when(F.col("kind") == RULE, slashes)), F.lit(0)).alias("deepest"),
    ).first()
    table = build_filter(entries, blocks_for(size.n))
    url = F.col("url")
    urls = pages.select(F.col(url_col).alias("url")).where(url.isNotNull()).distinct()
    split = urls.select(url, host_of(url).alias("host"), path_of_url(url).alias("path"), canonical_url(url).alias("canonical"))
    hits = exact_hits(possible_hits(split, table, size.deepest), entries, size.n, size.longest)
    ranked = hits.groupBy("url").agg(
        F.max(F.when(F.col("kind") == RULE, F.struct(F.length("key"), "key", "verdict"))).alias("best"),
        F.max(F.when(F.col("kind") == EXACT, F.col("verdict"))).alias("exact"),
    )
    key, rule, by_rule, exact = free_names(pages, "_url", "_rule", "_by_rule", "_exact")
    found = ranked.select(
        url.alias(key), F.col("best.key").alias(rule), F.col("best.verdict").alias(by_rule), F.col("exact").alias(exact)
    )
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_of(F.col(url_col)), path_of_url(F.col(url_col))
    return pages.join(found, pages[url_col] == found[key], "left").select(
        *[pages[c] for c in kept],
        host.alias("host"),
        path.alias("path"),
        F.col(rule).alias("rule"),
        F.coalesce(by_rule, exact, F.lit(ALLOW)).alias("verdict"),
    )
