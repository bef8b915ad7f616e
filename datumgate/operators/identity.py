"""Fingerprints of files, of datasets and of content; version identifiers."""

from __future__ import annotations

import hashlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import digest_text, limb_sums, row_text, word_totals
from ..sources.files import detect_formats, file_name, is_hidden, open_file, outer_roots, require_path, walk_files

# Files up to this size are hashed from the binaryFile source, which holds a
# whole file in one row; larger ones are streamed through the hash in a task.
IN_ROW_BYTES = 64 << 20
READ_BYTES = 1 << 20


def file_fingerprints(spark: SparkSession, paths: str | list[str], *, in_row_bytes: int = IN_ROW_BYTES) -> DataFrame:
    """``(path, length, fingerprint)``: hex SHA-256 of the bytes of every file.

    Files that Spark's scan delivers, up to ``in_row_bytes``, are hashed from its rows; larger, empty and hidden
    ones are streamed through the hash. One file is one sequential hash, so the work is spread over files.
    """
    roots = outer_roots(spark, paths)
    every = walk_files(spark, roots)
    scanned = ~is_hidden(F.col("root"), F.col("path")) & F.col("length").between(1, in_row_bytes)
    load = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load
    small = load(roots).where(F.col("length").between(1, in_row_bytes))
    path = F.col("path")
    below = lambda root: (path == root) | F.startswith(path, F.concat(root, F.lit("/")))
    small = small.where(~F.exists(F.lit(roots), lambda root: below(root) & is_hidden(root, path)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = every.where(~scanned).repartition(tasks, "path")
    hashed = small.select("path", "length", F.sha2("content", 256).alias("fingerprint"))
    return hashed.unionByName(stream_fingerprints(rest))


def data_fingerprints(spark: SparkSession, paths: list[str], *, in_row_bytes: int = IN_ROW_BYTES) -> DataFrame:
    """``file_fingerprints`` of the files a dataset is read from: those that Spark's scans list.

    Both branches push their length filter into the listing; the scan already puts
    each large file into a partition of its own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    small = files.where(F.col("length") <= in_row_bytes).select(
        "path", "length", F.sha2("content", 256).alias("fingerprint")
    )
    large = files.where(F.col("length") > in_row_bytes).select("path", "length")
    return small.unionByName(stream_fingerprints(large))


def stream_fingerprints(files: DataFrame) -> DataFrame:
    """Hash files in constant memory, whatever their size."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                with open_file(path) as source:
                    while chunk := source.read(READ_BYTES):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("length"), pa.array(digests, pa.string())],
                names=["path", "length", "fingerprint"],
            )

    return files.select("path", "length").mapInArrow(hashed, "path string, length bigint, fingerprint string")


def manifest_fingerprints(files: DataFrame, keys: list[str], relative: str = "relative_path") -> DataFrame:
    """One fingerprint per dataset from ``(keys, relative path, length, fingerprint)``.

    A dataset that is a single file keeps that file's fingerprint. A folder gets
    a digest over the multiset of (path, fingerprint) pairs, which adds up in
    partial aggregates: a folder of any number of files never meets in one task.
    """
    entry = F.sha2(F.concat_ws(":", F.col(relative), F.col("fingerprint")), 256)
    folded = files.withColumn("__entry", entry).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("length").alias("byte_size"),
        F.max(F.when(F.col(relative) == "", F.col("fingerprint"))).alias("__single"),
        *limb_sums(F.col("__entry")),
    )
    sums = folded.select(*keys, "file_count", "byte_size", "__single", *word_totals())
    folder = digest_text(F.col("file_count"), *[F.col(f"s{i}") for i in range(4)])
    return sums.select(*keys, "file_count", "byte_size", F.coalesce("__single", folder).alias("fingerprint"))


def directory_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of all files below one folder, by their paths relative to it."""
    root = require_path(spark, folder)
    files = file_fingerprints(spark, folder)
    # Empty for a single file, which keeps its own fingerprint.
    relative = F.ltrim(F.substring("path", len(root) + 1, 2**31 - 1), F.lit("/"))
    return manifest_fingerprints(files.withColumn("relative_path", relative), [])


def version_id(fingerprint: Column, schema_json: Column) -> Column:
    """Identifier of a dataset version: SHA-256 over fingerprint and schema text."""
    return F.sha2(F.concat(fingerprint, schema_json), 256)


def dataset_names(spark: SparkSession, paths: list[str], names: dict[str, str]) -> Column:
    """Name of each file: its path below the longest of ``paths`` above it, so that equal base names stay apart.

    A name given for a folder precedes the path below it; a file given itself has
    its given name, or else its base name.
    """
    path = F.col("path")
    chosen = file_name(path)
    roots = {require_path(spark, p).rstrip("/"): names.get(p) for p in paths}
    for root, given in sorted(roots.items()):
        below = F.substring(path, len(root) + 2, 2**31 - 1)
        chosen = (
            F.when(path == root, F.lit(given) if given else file_name(path))
            .when(path.startswith(root + "/"), F.concat(F.lit(f"{given}/"), below) if given else below)
            .otherwise(chosen)
        )
    return chosen


def register_files(spark: SparkSession, paths: str | list[str], names: dict[str, str] | None = None) -> DataFrame:
    """Light registration rows: name, format, fingerprint and size, no rows read.

    ``names`` gives names to some of ``paths``. ``row_count`` is 0 until the files are profiled.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    formats = detect_formats(walk_files(spark, paths).select("path", "length")).select("path", "format")
    return (
        file_fingerprints(spark, paths)
        .join(formats, "path")
        .select(
            dataset_names(spark, paths, names or {}).alias("name"),
            "path",
            "format",
            "fingerprint",
            F.lit(0).cast("bigint").alias("row_count"),
            F.col("length").alias("byte_size"),
        )
    )


def content_state(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Additive state of the rows: count and word sums. States of parts add up."""
    keys = by or []
    schema = df.drop(*keys).schema
    hashed = df.select(*keys, F.sha2(row_text(schema), 256).alias("__digest"))
    folded = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *limb_sums(F.col("__digest")))
    return folded.select(*keys, "row_count", *word_totals())


def merge_content_states(states: DataFrame) -> DataFrame:
    return states.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        *[F.coalesce(F.sum(f"s{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)],
    )


def fingerprint_of_state(state: DataFrame, schema_json: str) -> DataFrame:
    digest = digest_text(F.lit(schema_json), F.col("row_count"), *[F.col(f"s{i}") for i in range(4)])
    return state.select("row_count", digest.alias("content_fingerprint"))


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row: the row count and a fingerprint of the schema and the multiset of rows.

    Order and partitioning do not matter. One partial and one final aggregation.
    """
    return fingerprint_of_state(content_state(df), df.schema.json())
