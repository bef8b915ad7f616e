"""Ingestion: from file paths to registered, versioned datasets."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cancellation import Cancellation
from ..errors import (
    CORRUPTED_BATCH,
    INVALID_FORMAT,
    IO,
    RESOURCE_LIMIT_EXCEEDED,
    SCHEMA_MISMATCH,
    UNSUPPORTED_DATA_TYPE,
    EngineError,
    error_for,
)
from ..functions.cells import NULL_CELL, TYPES, type_of_mask
from ..functions.local import local_frame
from ..functions.schema_diff import Difference
from ..model import CSV, PARQUET, CsvOptions, IngestionOptions, IngestionSource
from ..sources.delimited import header_rows, names_of
from ..sources.files import detect_formats, key_fields, list_files, outermost, qualified, with_keys
from ..sources.footers import dataset_facts
from ..sources.scan import csv_options, read_parquet, scan
from ..sources.verify import first_faults
from .identity import data_fingerprints, manifest_fingerprints
from .infer import file_masks
from .manifests import Manifests
from .registry import Registry
from .schema_changes import json_differences

# Above this many sources their table is joined by shuffle, not broadcast.
BROADCAST_SOURCES = 10_000

INSPECTED = """
    ord bigint, name string, path string, format string, schema_json string, row_count bigint,
    row_count_is_sampled boolean, byte_size bigint, fingerprint string, nanos boolean, error_code string, error_message string
"""


def _files_of(sources: DataFrame, files: DataFrame, count: int) -> DataFrame:
    """Files paired with the sources whose path is the file or a folder above it.

    Every file lists its own ancestors, which makes the match an equality.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    spread = files.withColumn("root", F.explode(above))
    listed = F.broadcast(sources) if count <= BROADCAST_SOURCES else sources
    relative = F.substring(F.col("path"), F.length("root") + 2, F.length("path"))
    return spread.join(listed, "root").withColumn("relative_path", relative)


def inspect_sources(
    spark: SparkSession,
    sources: Sequence[IngestionSource],
    options: IngestionOptions = IngestionOptions(),
    *,
    manifests: Manifests | None = None,
    cancellation: Cancellation | None = None,
) -> DataFrame:
    """One row per source with its facts, or with the first error in check order.

    Order: missing, empty, too large, undetectable, unsupported type, corrupt.
    Sizes come from the listing; only sources within the limit are read. With ``manifests`` only
    files that these do not know yet are hashed.
    """
    proceed = (cancellation or Cancellation(spark)).check
    results: dict[int, dict] = {}
    found = []
    for i, source in enumerate(sources):
        full, there = qualified(spark, source.source_path)
        full = full.rstrip("/")
        results[i] = dict(ord=i, name=source.name, path=source.source_path)
        if there:
            found.append((i, full, source.format_hint))
        else:
            _fail(results[i], IO, f"No such source: {source.source_path}")
    if found:
        proceed()
        _sizes(spark, found, results, options)
    accepted = [f for f in found if "error_code" not in results[f[0]]]
    if accepted:
        proceed()
        _facts(spark, accepted, results, options.verify, manifests)
    texts = [f for f in accepted if results[f[0]].get("format") == CSV and "error_code" not in results[f[0]]]
    if texts:
        proceed()
        _delimited_facts(spark, texts, {i: csv_options(spark, full, sources[i].csv) for i, full, _ in texts}, results)
    for i, _, _ in accepted:
        _sample(results[i], options)
    columns = [c.split()[0] for c in INSPECTED.split(",")]
    rows = [tuple(results[i].get(c) for c in columns) for i in range(len(sources))]
    return local_frame(spark, rows, INSPECTED)


def _fail(result: dict, code: str, message: str) -> None:
    result.update(error_code=code, error_message=message)


def _source_frame(spark: SparkSession, found: list[tuple]) -> DataFrame:
    return local_frame(spark, found, "ord bigint, root string, hint string")


def _sizes(spark: SparkSession, found: list[tuple], results: dict, options: IngestionOptions) -> None:
    files = list_files(spark, outermost([f[1] for f in found]))
    paired = _files_of(_source_frame(spark, found), files, len(found))
    sizes = {r.ord: r.bytes for r in paired.groupBy("ord").agg(F.sum("length").alias("bytes")).collect()}
    for i, _, _ in found:
        size = results[i]["byte_size"] = sizes.get(i, 0)
        if size == 0:
            _fail(results[i], INVALID_FORMAT, "Source is empty (0 bytes)")
        elif options.max_bytes is not None and size > options.max_bytes:
            _fail(
                results[i],
                RESOURCE_LIMIT_EXCEEDED,
                f"File size {size} bytes exceeds configured limit of {options.max_bytes} bytes",
            )


def _fingerprints(spark: SparkSession, roots: list[str], frame: DataFrame, count: int) -> DataFrame:
    paired = _files_of(frame, data_fingerprints(spark, roots), count).where("length > 0")
    return manifest_fingerprints(paired, ["ord"]).select("ord", "fingerprint")


def _known_fingerprints(spark: SparkSession, roots: list[str], frame: DataFrame, count: int, manifests: Manifests) -> DataFrame:
    """``_fingerprints`` from manifests, which are brought up to the files there are."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    files = listing.where("length > 0").select("path", "length", F.col("modificationTime").alias("modified_at"))
    datasets = frame.select("root").distinct()
    paired = _files_of(datasets, files, count).withColumnRenamed("root", "dataset")
    manifests.update(paired, datasets.withColumnRenamed("root", "dataset"))
    totals = manifests.totals().select(F.col("dataset").alias("root"), "fingerprint")
    return frame.join(totals, "root").select("ord", "fingerprint")


def _facts(spark: SparkSession, accepted: list[tuple], results: dict, verify: bool, manifests: Manifests | None) -> None:
    """Fingerprints, formats, schemas and row counts of all sources in one job each."""
    roots = outermost([f[1] for f in accepted])
    frame = _source_frame(spark, accepted)
    if manifests is None:
        prints = _fingerprints(spark, roots, frame, len(accepted))
    else:
        prints = _known_fingerprints(spark, roots, frame, len(accepted), manifests)
    detected = detect_formats(list_files(spark, roots))
    typed = _files_of(frame, detected, len(accepted)).where("length > 0")
    typed = typed.withColumn("format", F.coalesce("hint", "format"))
    facts = dataset_facts(typed, "ord", faults=first_faults(typed) if verify else None)
    for row in facts.join(prints, "ord").collect():
        result = results[row.ord]
        result.update(format=row.format, fingerprint=row.fingerprint)
        if row.error_code is not None:
            _fail(result, row.error_code, f"{result['path']}: {row.error_message}")
            continue
        result.update(schema_json=row.schema_json, row_count=row.row_count, nanos=row.nanos, partitioned=row.partitioned)
        if row.partitioned and row.format != CSV:
            _with_partitions(spark, result)


def _with_partitions(spark: SparkSession, result: dict) -> None:
    """The stated schema gets the partition columns that a scan adds to it."""
    stated = T.StructType.fromJson(json.loads(result["schema_json"]))
    if result["format"] == PARQUET:
        added = [f for f in read_parquet(spark, result["path"], True).schema.fields if f.name not in stated.names]
        result["schema_json"] = T.StructType(stated.fields + added).json()
        return
    try:
        keys = T.StructType(key_fields(spark, result["path"]))
        result["schema_json"] = with_keys(stated, keys, result["path"]).json()
    except EngineError as failure:
        _fail(result, failure.code, failure.message)


def _delimited_facts(spark: SparkSession, found: list[tuple], options_of: dict[int, CsvOptions], results: dict) -> None:
    """Delimited text states no schema: types and row counts of all sources in one pass per notation.

    The number of jobs depends on how many different options the sources have.
    """
    for options in dict.fromkeys(options_of.values()):
        members = [f for f in found if options_of.get(f[0]) == options]
        roots = outermost([f[1] for f in members])
        files = _files_of(_source_frame(spark, members), list_files(spark, roots), len(members))
        files = files.where("length > 0").select("ord", "path")
        headers = {r.ord: r for r in header_rows(files, "ord", options.delimiter).collect()}
        masks = file_masks(spark, roots, options).join(files, "path").groupBy("ord", "position")
        folded = masks.agg(F.bit_or("mask").alias("mask"), F.sum("lines").alias("lines"))
        cells = {}
        typed = folded.withColumn("data_type", type_of_mask(F.coalesce("mask", F.lit(NULL_CELL))))
        for row in typed.where(F.col("position") < max((len(h.cells) for h in headers.values()), default=0)).collect():
            cells[row.ord, row.position] = row
        for i, _, _ in members:
            try:
                names = names_of(headers.get(i), results[i]["path"], options.has_header)
            except EngineError as failure:
                _fail(results[i], failure.code, failure.message)
                continue
            found_types = [cells[i, p].data_type if (i, p) in cells else "string" for p in range(len(names))]
            schema = T.StructType([T.StructField(n, TYPES[t], True) for n, t in zip(names, found_types)])
            results[i].update(schema_json=schema.json(), row_count=cells[i, 0].lines if (i, 0) in cells else 0)
            if results[i]["partitioned"]:
                _with_partitions(spark, results[i])


def _sample(result: dict, options: IngestionOptions) -> None:
    rows, limit = result.get("row_count"), options.sample_limit
    if rows is not None:
        result["row_count_is_sampled"] = limit is not None and rows > limit
        result["row_count"] = rows if limit is None else min(rows, limit)


def _refuse_drift(registry: Registry, inspected: DataFrame) -> list[tuple]:
    """Rows in which sources whose name is known with another schema are errors that name the fields.

    A name is known from the registry or from an earlier source of the same call.
    """
    known = registry.current().select("name", F.col("schema_json").alias("known_schema"))
    first = inspected.where("error_code is null").groupBy("name").agg(F.min_by("schema_json", "ord").alias("first_schema"))
    joined = inspected.join(known, "name", "left").join(first, "name", "left")
    expected = F.coalesce("known_schema", "first_schema")
    drifts = F.col("error_code").isNull() & (F.col("schema_json") != expected)
    message = F.concat(F.lit("Schema of '"), F.col("name"), F.lit("' differs from its registered version"))
    marked = joined.withColumns(
        {
            "error_code": F.when(drifts, F.lit(SCHEMA_MISMATCH)).otherwise(F.col("error_code")),
            "error_message": F.when(drifts, message).otherwise(F.col("error_message")),
            "drifted": drifts,
            "expected": expected,
        }
    )
    rows = []
    # One row per source the caller listed.
    for *row, drifted, known_json in marked.select(*inspected.columns, "drifted", "expected").collect():
        if drifted:
            at = inspected.columns.index("schema_json")
            row[-1] += ": " + "; ".join(map(_in_words, json_differences(known_json, row[at])))
        rows.append(tuple(row))
    return rows


def _in_words(found: Difference) -> str:
    return " ".join(filter(None, (found.path, found.change, " to ".join(filter(None, (found.before, found.after))))))


def ingest(
    spark: SparkSession,
    registry: Registry,
    sources: Sequence[IngestionSource],
    options: IngestionOptions = IngestionOptions(),
    *,
    manifests: Manifests | None = None,
    cancellation: Cancellation | None = None,
) -> DataFrame:
    """Register every source that passes its checks; one result row per source.

    Rows of rejected sources carry ``error_code`` and ``error_message`` instead
    of a dataset. The files of all sources are listed, hashed and inspected
    together, in jobs whose number does not depend on how many sources there are
    (only on how many different notations their delimited text has). With ``manifests`` only files that
    are new or changed since the last call are hashed. A cancelled call raises ``Cancelled``
    and registers nothing.
    """
    cancellation = cancellation or Cancellation(spark)
    with cancellation:
        return _ingest(spark, registry, sources, options, manifests, cancellation)


def _ingest(
    spark: SparkSession,
    registry: Registry,
    sources: Sequence[IngestionSource],
    options: IngestionOptions,
    manifests: Manifests | None,
    cancellation: Cancellation,
) -> DataFrame:
    inspected = inspect_sources(spark, sources, options, manifests=manifests, cancellation=cancellation)
    cancellation.check()
    if options.strict_schema:
        # Fixed before the log grows.
        inspected = local_frame(spark, _refuse_drift(registry, inspected), INSPECTED)
    accepted = inspected.where("error_code is null").drop("nanos", "error_code", "error_message")
    cancellation.check()
    stored = registry.register(accepted).select(
        "ord", "dataset_id", "version_id", F.col("at").alias("ingested_at"), "pipeline_version"
    )
    return inspected.join(stored, "ord", "left").select(
        "ord",
        "dataset_id",
        "version_id",
        "name",
        "format",
        "schema_json",
        "row_count",
        "row_count_is_sampled",
        "byte_size",
        "fingerprint",
        F.struct(
            F.col("path").alias("source_path"),
            F.col("fingerprint").alias("source_fingerprint"),
            "ingested_at",
            "pipeline_version",
        ).alias("lineage"),
        _diagnostics().alias("diagnostics"),
        "error_code",
        "error_message",
    )


def _diagnostics() -> Column:
    accepted = F.col("error_code").isNull()
    notes = F.array(
        F.when(
            accepted & (F.col("row_count") == 0),
            F.struct(
                F.lit(CORRUPTED_BATCH).alias("code"),
                F.lit("Registered with its columns only: it has 0 rows").alias("message"),
                F.lit("See whether whatever writes this source had finished").alias("suggested_action"),
            ),
        ),
        F.when(
            accepted & F.col("nanos"),
            F.struct(
                F.lit(UNSUPPORTED_DATA_TYPE).alias("code"),
                F.lit("Nanosecond timestamps are read with microsecond precision").alias("message"),
                F.lit("Store timestamps in microseconds to keep every digit").alias("suggested_action"),
            ),
        ),
    )
    return F.filter(notes, lambda note: note.isNotNull())


@dataclass(frozen=True)
class IngestionResult:
    dataset_id: str
    version_id: str
    name: str
    format: str
    schema: T.StructType
    row_count: int
    row_count_is_sampled: bool
    byte_size: int
    source_fingerprint: str
    lineage: Row
    diagnostics: list[Row]


def ingest_one(
    spark: SparkSession,
    registry: Registry,
    source: IngestionSource,
    options: IngestionOptions = IngestionOptions(),
) -> IngestionResult:
    """Ingest a single source; raises the error that rejected it."""
    [row] = ingest(spark, registry, [source], options).collect()
    if row.error_code is not None:
        raise error_for(row.error_code, row.error_message)
    return IngestionResult(
        dataset_id=row.dataset_id,
        version_id=row.version_id,
        name=row.name,
        format=row.format,
        schema=T.StructType.fromJson(json.loads(row.schema_json)),
        row_count=row.row_count,
        row_count_is_sampled=row.row_count_is_sampled,
        byte_size=row.byte_size,
        source_fingerprint=row.fingerprint,
        lineage=row.lineage,
        diagnostics=row.diagnostics,
    )


def preview(spark: SparkSession, source: IngestionSource, rows: int) -> DataFrame:
    """The first rows of a source, as its scan would deliver them."""
    return scan(spark, source.source_path, source.format_hint, csv=source.csv, sample_limit=rows)
