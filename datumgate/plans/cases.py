"""Registered queries on written copies of the tables: layouts, errors, lookups. Each has its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..model import ARROW_IPC, CSV, PARQUET, IngestionOptions, IngestionSource
from ..operators.identity import file_fingerprints
from ..operators.ingest import ingest, preview
from ..operators.infer import infer_masks
from ..operators.profile import column_states, exact_distinct, merge_states, profile_columns
from ..operators.registry import Registry, resolve, versions
from ..operators.schema_changes import schema_differences as differences_of
from ..session import scratch_dir
from ..sources.arrow_ipc import read_ipc, write_ipc
from ..sources.files import filesystem_of, list_files, open_file, qualified
from ..sources.scan import scan
from ..sources.verify import check_files, parts_of
from .tables import TABLES, table

NAMESPACE = "cases"
PREVIEW = 10
# Standard error of the distinct sketch asked for, and how many of them count as close.
RSD, CLOSE = 0.02, 5
# Distance of neighbouring order values of one name.
GAP = 1_000_003
# Where all order values but the first lie.
BURST = 10**15
# Size above which a stream is split in ``ipc_split_stream``.
SPLIT_BYTES = 32 << 10
# The column whose pages are overwritten in one copy.
BROKEN_COLUMN = "o_orderpriority"


def _nested(spark: SparkSession, sf_dir: str) -> str:
    """Orders as files of a folder and of a folder below it."""
    folder = scratch_dir(spark, "nested")
    orders = table(spark, sf_dir, "orders")
    finished = F.col("o_orderstatus") == "F"
    orders.where(finished).write.parquet(f"{folder}/top")
    orders.where(~finished).write.parquet(f"{folder}/top/deep")
    return f"{folder}/top"


def _partitioned(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_dir(spark, "partitioned")
    table(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").parquet(folder)
    return folder


def _tsv(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_dir(spark, "tsv")
    writer = table(spark, sf_dir, "customer").write.option("header", "true").option("sep", "\t")
    writer.option("extension", "tsv").csv(folder)
    return folder


def _differing(spark: SparkSession, sf_dir: str, write: Callable[[DataFrame, str], object]) -> str:
    """Nations in two folders of one dataset, the second without a column."""
    folder = scratch_dir(spark, "differing")
    nations = table(spark, sf_dir, "nation")
    write(nations, f"{folder}/whole")
    write(nations.drop("n_name"), f"{folder}/short")
    return folder


def _outcome(call: Callable[[], DataFrame]) -> str:
    try:
        call().count()
    except EngineError as failure:
        return failure.code
    return "read"


def scan_nested_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, _nested(spark, sf_dir))


def scan_partitioned_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, _partitioned(spark, sf_dir))


def _keyed(spark: SparkSession, sf_dir: str, write: Callable[[DataFrame, str], object]) -> str:
    """Orders as a Hive layout by status in a format whose writer knows none."""
    folder = scratch_dir(spark, "keyed")
    orders = table(spark, sf_dir, "orders")
    # A status is a letter, so there are few.
    for (status,) in orders.select("o_orderstatus").distinct().collect():
        write(orders.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), f"{folder}/o_orderstatus={status}")
    return folder


def scan_partitioned_ipc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, _keyed(spark, sf_dir, write_ipc))


def scan_partitioned_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(df: DataFrame, path: str) -> None:
        # Spark's writer puts a T into zoneless timestamps, which inference takes for text.
        dated = df.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
        dated.write.option("header", "true").csv(path)

    return scan(spark, _keyed(spark, sf_dir, write))


def ipc_split_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams read by several tasks, beside the rows that their message headers state."""
    folder = scratch_dir(spark, "streams")
    write_ipc(table(spark, sf_dir, "events"), folder, "stream")
    read = read_ipc(spark, folder, partition_bytes=SPLIT_BYTES).withColumn("task", F.spark_partition_id())
    registry = Registry(spark, scratch_dir(spark, "registry"), NAMESPACE)
    stated = ingest(spark, registry, [IngestionSource("events", folder)]).select(F.col("row_count").alias("stated_rows"))
    found = read.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("event_id").alias("event_ids"),
        F.sum("user_id").alias("user_ids"),
        (F.count_distinct("task") > 1).alias("is_split"),
    )
    return found.join(stated)


def tsv_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, _tsv(spark, sf_dir))


def folder_schema_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets whose files disagree are refused in every format, by scan and by ingestion."""
    folders = {
        "parquet": _differing(spark, sf_dir, lambda df, path: df.write.parquet(path)),
        "arrow_ipc": _differing(spark, sf_dir, write_ipc),
        "csv": _differing(spark, sf_dir, lambda df, path: df.write.option("header", "true").csv(path)),
    }
    scanned = [("scan", name, _outcome(lambda p=path: scan(spark, p))) for name, path in folders.items()]
    registry = Registry(spark, scratch_dir(spark, "registry"), NAMESPACE)
    ingested = ingest(spark, registry, [IngestionSource(name, path) for name, path in folders.items()])
    codes = ingested.select(F.lit("ingest").alias("way"), "name", F.coalesce("error_code", F.lit("read")).alias("outcome"))
    return spark.createDataFrame(scanned, "way string, name string, outcome string").unionByName(codes)


def ingest_matches_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered row counts and columns next to what a scan of the same folder delivers."""
    folders = {"nested": _nested(spark, sf_dir), "partitioned": _partitioned(spark, sf_dir), "tsv": _tsv(spark, sf_dir)}
    registry = Registry(spark, scratch_dir(spark, "registry"), NAMESPACE)
    sources = [IngestionSource(name, path) for name, path in folders.items()]
    fields = F.size(F.from_json(F.get_json_object("schema_json", "$.fields"), "array<string>"))
    stated = ingest(spark, registry, sources).select("name", "row_count", fields.alias("columns"))
    found = None
    for name, path in folders.items():
        df = scan(spark, path)
        row = df.agg(F.count(F.lit(1)).alias("scanned_rows")).select(
            F.lit(name).alias("name"), "scanned_rows", F.lit(len(df.columns)).alias("scanned_columns")
        )
        found = row if found is None else found.unionByName(row)
    return stated.join(found, "name")


def ingest_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage and diagnostics of a dataset with rows and of one without."""
    orders, folder = table(spark, sf_dir, "orders"), scratch_dir(spark, "lineage")
    orders.write.parquet(f"{folder}/full")
    orders.limit(0).write.parquet(f"{folder}/none")
    registry = Registry(spark, scratch_dir(spark, "registry"), NAMESPACE)
    sources = [IngestionSource(name, f"{folder}/{name}") for name in ("full", "none")]
    return ingest(spark, registry, sources, IngestionOptions(verify=True)).select(
        "name",
        "row_count",
        F.endswith("lineage.source_path", F.concat(F.lit("/"), F.col("name"))).alias("path_kept"),
        (F.col("lineage.source_fingerprint") == F.col("fingerprint")).alias("fingerprint_kept"),
        F.col("lineage.ingested_at").isNotNull().alias("time_kept"),
        F.col("lineage.pipeline_version").alias("pipeline_version"),
        F.array_join("diagnostics.code", ",").alias("codes"),
    )


def registry_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset found by name and by id, removed, then not found."""
    customer = table(spark, sf_dir, "customer")
    registry = Registry(spark, scratch_dir(spark, "registry"), NAMESPACE)
    registry.register(
        customer.select(
            F.col("c_custkey").alias("ord"),
            F.col("c_name").alias("name"),
            F.lit("/data").alias("path"),
            F.lit(PARQUET).alias("format"),
            F.lit("{}").alias("schema_json"),
            F.sha2(F.col("c_name"), 256).alias("fingerprint"),
            F.col("c_custkey").alias("row_count"),
            F.lit(False).alias("row_count_is_sampled"),
            F.col("c_custkey").alias("byte_size"),
        )
    )
    [first] = customer.agg(F.min("c_name").alias("name")).collect()
    [named] = registry.get_by_name(first.name).collect()
    [found] = registry.get(named.dataset_id).collect()
    [gone] = registry.remove(named.dataset_id).collect()
    rows = [("name", named.name, named.row_count), ("id", found.name, found.row_count), ("removed", gone.name, gone.row_count)]
    rows.append((_outcome(lambda: registry.get_by_name(first.name)), first.name, None))
    listed = registry.list().agg(F.lit("listed").alias("way"), F.min("name").alias("name"), F.count(F.lit(1)).alias("value"))
    return spark.createDataFrame(rows, "way string, name string, value bigint").unionByName(listed)


def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a preview shows, and how many of them the dataset holds."""
    folder = _nested(spark, sf_dir)
    shown = preview(spark, IngestionSource("orders", folder), PREVIEW)
    held = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("held"))
    joined = shown.join(held, "o_orderkey", "left")
    return joined.agg(F.count(F.lit(1)).alias("shown"), F.count("held").alias("held"))


def profile_empty_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = profile_columns(table(spark, sf_dir, "lineitem").where("l_orderkey < 0"), extended=True)
    sides = [F.col(c) for c in profile.columns if c.startswith(("min_", "max_"))]
    bounded = F.coalesce(*[c.cast("string") for c in sides]).isNotNull()
    return profile.select("column", "total_count", "null_count", "null_percentage", bounded.alias("has_bounds"))


def _close(estimate: Column, exact: Column) -> Column:
    return F.abs(estimate - exact) <= F.greatest(F.lit(2.0), exact * (CLOSE * RSD))


def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether distinct estimates, direct and merged from parts, lie close to the exact counts."""
    lineitem = table(spark, sf_dir, "lineitem")
    direct = profile_columns(lineitem, approx_distinct=RSD).select("column", F.col("distinct_count_approx").alias("direct"))
    parts = column_states(lineitem.withColumn("part", F.month("l_shipdate")), by=["part"], sketches=True)
    merged = merge_states(parts).select("column", F.col("distinct_count_approx").alias("merged"))
    exact = exact_distinct(lineitem).select("column", "distinct_count")
    return exact.join(direct, "column").join(merged, "column").select(
        "column",
        _close(F.col("direct"), F.col("distinct_count")).alias("direct_close"),
        _close(F.col("merged"), F.col("distinct_count")).alias("merged_close"),
    )


def csv_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without a line, and files under different headers, have no schema."""
    blank = scratch_dir(spark, "blank")
    table(spark, sf_dir, "region").select(F.lit("  ").alias("value")).write.text(blank)
    differing = _differing(spark, sf_dir, lambda df, path: df.write.option("header", "true").csv(path))
    rows = [(name, _outcome(lambda p=path: infer_masks(spark, p))) for name, path in (("blank", blank), ("headers", differing))]
    rows.append(("scan", _outcome(lambda: scan(spark, blank, CSV))))
    return spark.createDataFrame(rows, "name string, outcome string")


def registry_gappy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five names with a fifth of all events each, whose numbers lie far apart."""
    events = table(spark, sf_dir, "events").select(
        (F.col("event_id") * GAP).alias("seq"),
        F.lit("register").alias("op"),
        F.col("event_type").alias("name"),
        F.col("props").alias("schema_json"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("fingerprint"),
        F.col("ts").alias("at"),
    )
    history = versions(resolve(events, NAMESPACE, width=1000))
    return history.select("seq", "version_id", "parent_version_id", "changed", "schema_changed")


def _broken_copies(files: DataFrame, target: str) -> DataFrame:
    """Copies of one Parquet and one IPC file, which hold rows, below ``target``, each with other bytes overwritten; done in tasks.

    ``pages``: the pages of one column of the first row group. ``footer``: all of it.
    ``batches``: the header of the first record batch.
    """

    def copy(path: str, kind: str) -> str:
        from pyarrow import parquet

        out = f"{target}/{kind}"
        with open_file(path) as source:
            size = source.size()
            if kind == "pages":
                group = parquet.ParquetFile(source).metadata.row_group(0)
                [chunk] = [c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == BROKEN_COLUMN]
                first = chunk.dictionary_page_offset if chunk.has_dictionary_page else chunk.data_page_offset
                low, high = first, first + chunk.total_compressed_size
            elif kind == "footer":
                # Its length stands before the closing magic. A few bytes of it, overwritten, may still be a footer.
                source.seek(size - 8)
                low, high = size - 8 - int.from_bytes(source.read(4), "little"), size - 8
            else:
                # An IPC file starts with its magic, then the schema's length, the schema and the first batch.
                source.seek(12)
                low = 16 + int.from_bytes(source.read(4), "little") + 8
                high = low + 64
            source.seek(0)
            filesystem, place = filesystem_of(out)
            filesystem.create_dir(place)
            with filesystem.open_output_stream(f"{place}/file") as sink:
                at = 0
                while piece := source.read(1 << 20):
                    piece = bytearray(piece)
                    for k in range(max(low - at, 0), min(high - at, len(piece))):
                        piece[k] = (k * 37 + 11) % 256
                    sink.write(bytes(piece))
                    at += len(piece)
        return f"{out}/file"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [copy(p, k) for p, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *batch.columns[1:]], names=["path", "format", "kind"])

    return files.select("path", "format", "kind").mapInArrow(run, "path string, format string, kind string")


def verify_broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as Parquet and as Arrow IPC, all sound, beside copies of a file of each with broken bytes."""
    orders = table(spark, sf_dir, "orders")
    parquet, ipc, broken = (scratch_dir(spark, f"verify-{name}") for name in ("parquet", "ipc", "broken"))
    orders.write.parquet(parquet)
    write_ipc(orders, ipc)
    whole = [list_files(spark, p).where("length > 0").select("path", F.lit(f).alias("format")) for p, f in ((parquet, PARQUET), (ipc, ARROW_IPC))]
    # Spark's writer leaves a file without a row group where its first task had no rows.
    held = parts_of(whole[0].unionByName(whole[1])).where("part = 0")
    first = held.groupBy("format").agg(F.min("path").alias("path"))
    kinds = F.when(F.col("format") == PARQUET, F.array(F.lit("pages"), F.lit("footer"))).otherwise(F.array(F.lit("batches")))
    copies = _broken_copies(first.withColumn("kind", F.explode(kinds)), broken)
    named = scratch_dir(spark, "verify-copies")
    copies.write.parquet(named)
    files = whole[0].unionByName(whole[1]).withColumn("kind", F.lit("whole")).unionByName(spark.read.parquet(named))
    found = check_files(files).join(files.select("path", "kind").dropDuplicates(["path"]), "path")
    faults = F.col("error").isNotNull()
    return found.groupBy("format", "kind").agg(
        F.sum(F.when(F.col("kind") == "whole", F.col("row_count"))).alias("sound_rows"),
        F.count_distinct(F.when(faults, F.col("path"))).alias("broken_files"),
        F.min(F.when(faults, F.coalesce("part", F.lit(-1)))).alias("first_broken_part"),
        F.array_join(F.array_sort(F.collect_set(F.when(faults, F.col("column")))), ",").alias("broken_columns"),
    )


def listing_sees_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of a partitioned copy of orders that hold files, and the empty marker beside them, with its hash."""
    folder = _partitioned(spark, sf_dir)
    relative = F.substr("path", F.length(F.lit(qualified(spark, folder)[0])) + 2)
    prints = file_fingerprints(spark, folder).withColumn("name", F.split_part(relative, F.lit("/"), F.lit(1)))
    marked = F.col("name").startswith("_")
    return prints.where(marked | F.col("path").endswith(".parquet")).groupBy("name").agg(
        F.max(F.col("length") == 0).alias("is_empty"), F.max(F.when(marked, F.col("fingerprint"))).alias("fingerprint")
    )


def registry_bursty_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and clicks as one name, all else as another; one event long before a burst of all others."""
    seq = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.when(seq == table(spark, sf_dir, "events").agg(F.min("event_id")).scalar(), F.lit(0)).otherwise(seq + BURST).alias("seq"),
        F.when(F.col("event_type") == "signup", F.lit("remove")).otherwise(F.lit("register")).alias("op"),
        F.when(F.col("event_type").isin("error", "click"), F.lit("few")).otherwise(F.lit("hot")).alias("name"),
        F.lit("{}").alias("schema_json"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("fingerprint"),
        F.col("ts").alias("at"),
    )
    history = resolve(events, NAMESPACE, width=1000)
    return history.select("seq", "op", "version_id", "parent_version_id", "is_open")


def ipc_uint64_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("l_partkey").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", big.cast("decimal(20,0)").alias("u64"))
    back = read_ipc(spark, write_ipc(lineitem, scratch_dir(spark, "ipc")))
    return back.withColumn("u64", F.col("u64").cast("string"))


def ipc_empty_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_ipc(spark, write_ipc(table(spark, sf_dir, "orders").where("o_orderkey < 0"), scratch_dir(spark, "ipc")))
    return back.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(back.columns)))


def _field(name: str, dtype: T.DataType | str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(dtype) if isinstance(dtype, str) else dtype, nullable)


def schema_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's schema, one per type of event, changes in a schema before it."""
    before = [_field("id", "int"), _field("at", "date"), _field("item", "struct<price:float,tags:array<int>>"), _field("note", "string")]
    number, at, item, note = before
    nested = _field("item", "struct<price:double,tags:array<bigint>,unit:string>")
    after = {
        "signup": [_field("id", "bigint"), at, item, note],
        "error": [_field("id", "smallint"), at, item],
        "click": [number, at, nested, note, _field("extra", "decimal(10,2)")],
        "purchase": [note, number, at, item],
    }
    chosen = F.lit(T.StructType([number, _field("at", "string"), item, _field("note", "string", False)]).json())
    for kind, fields in after.items():
        chosen = F.when(F.col("event_type") == kind, F.lit(T.StructType(fields).json())).otherwise(chosen)
    pairs = table(spark, sf_dir, "events").select(
        "event_id", F.lit(T.StructType(before).json()).alias("parent_schema_json"), chosen.alias("schema_json")
    )
    return differences_of(pairs)


def _values(columns: str, rows: list[str]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v({columns})"


CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "scan_nested_folder": (scan_nested_folder, "SELECT * FROM orders"),
    "scan_partitioned_folder": (scan_partitioned_folder, "SELECT * FROM orders"),
    "scan_partitioned_ipc": (scan_partitioned_ipc, "SELECT * FROM orders"),
    "scan_partitioned_csv": (scan_partitioned_csv, "SELECT * FROM orders"),
    "ipc_split_stream": (
        ipc_split_stream,
        """SELECT count(*) AS row_count, count(DISTINCT event_id) AS event_ids, sum(user_id)::BIGINT AS user_ids,
            true AS is_split, count(*) AS stated_rows FROM events""",
    ),
    "tsv_by_extension": (tsv_by_extension, "SELECT * REPLACE (c_nationkey::BIGINT AS c_nationkey) FROM customer"),
    "folder_schema_mismatch": (
        folder_schema_mismatch,
        _values(
            "way, name, outcome",
            [f"('{way}', '{name}', 'SchemaMismatch')" for way in ("scan", "ingest") for name in ("parquet", "arrow_ipc", "csv")],
        ),
    ),
    "ingest_matches_scan": (
        ingest_matches_scan,
        " UNION ALL ".join(
            f"SELECT '{name}' AS name, count(*) AS row_count, {n} AS columns, count(*) AS scanned_rows, {n} AS scanned_columns"
            f" FROM {source}"
            for name, source, n in (("nested", "orders", 6), ("partitioned", "orders", 6), ("tsv", "customer", 5))
        ),
    ),
    "ingest_lineage": (
        ingest_lineage,
        """SELECT 'full' AS name, count(*) AS row_count, true AS path_kept, true AS fingerprint_kept, true AS time_kept,
          'datumgate-ingestion-v1' AS pipeline_version, '' AS codes FROM orders
        UNION ALL SELECT 'none', 0, true, true, true, 'datumgate-ingestion-v1', 'CorruptedBatch'""",
    ),
    "registry_lookups": (
        registry_lookups,
        """WITH f AS (SELECT c_name AS name, c_custkey AS k FROM customer ORDER BY c_name LIMIT 1)
        SELECT way, name, CASE WHEN way <> 'DatasetNotFound' THEN k END AS value
        FROM f, (VALUES ('name'), ('id'), ('removed'), ('DatasetNotFound')) AS w(way)
        UNION ALL SELECT 'listed', min(c_name), count(*) FROM customer WHERE c_name NOT IN (SELECT name FROM f)""",
    ),
    "preview_rows": (preview_rows, f"SELECT {PREVIEW}::BIGINT AS shown, {PREVIEW}::BIGINT AS held"),
    "profile_empty_input": (
        profile_empty_input,
        'SELECT "column", 0::BIGINT AS total_count, 0::BIGINT AS null_count, 0.0::DOUBLE AS null_percentage,'
        " false AS has_bounds FROM (VALUES "
        + ", ".join(f"('{c}')" for c in TABLES["lineitem"])
        + ') AS v("column")',
    ),
    "distinct_sketches": (
        distinct_sketches,
        _values('"column", direct_close, merged_close', [f"('{c}', true, true)" for c in TABLES["lineitem"]]),
    ),
    "csv_rejected": (
        csv_rejected,
        _values("name, outcome", ["('blank', 'InvalidFormat')", "('headers', 'SchemaMismatch')", "('scan', 'InvalidFormat')"]),
    ),
    "registry_gappy_names": (
        registry_gappy_names,
        f"""WITH e AS (SELECT event_id * {GAP} AS seq, event_type, props,
            sha256(sha256(user_id::VARCHAR) || props) AS version_id FROM events),
        p AS (SELECT *, lag(version_id) OVER w AS parent_version_id, lag(props) OVER w AS parent_props
            FROM e WINDOW w AS (PARTITION BY event_type ORDER BY seq))
        SELECT seq, version_id, parent_version_id, coalesce(version_id <> parent_version_id, false) AS changed,
            coalesce(props <> parent_props, false) AS schema_changed FROM p""",
    ),
    "verify_broken_files": (
        verify_broken_files,
        f"""SELECT format, 'whole' AS kind, count(*) AS sound_rows, 0::BIGINT AS broken_files, NULL::BIGINT AS first_broken_part,
            '' AS broken_columns FROM orders, (VALUES ('parquet'), ('arrow_ipc')) AS f(format) GROUP BY format
        UNION ALL SELECT 'parquet', 'pages', NULL, 1, 0, '{BROKEN_COLUMN}'
        UNION ALL SELECT 'parquet', 'footer', NULL, 1, -1, ''
        UNION ALL SELECT 'arrow_ipc', 'batches', NULL, 1, 0, ''""",
    ),
    "listing_sees_all": (
        listing_sees_all,
        """SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS name, false AS is_empty, NULL::VARCHAR AS fingerprint FROM orders
        UNION ALL SELECT '_SUCCESS', true, sha256('')""",
    ),
    "registry_bursty_names": (
        registry_bursty_names,
        f"""WITH e AS (SELECT CASE WHEN event_id = (SELECT min(event_id) FROM events) THEN 0 ELSE event_id + {BURST} END AS seq,
            CASE WHEN event_type = 'signup' THEN 'remove' ELSE 'register' END AS op,
            CASE WHEN event_type IN ('error', 'click') THEN 'few' ELSE 'hot' END AS name,
            sha256(sha256(user_id::VARCHAR) || '{{}}') AS version FROM events),
        p AS (SELECT *, lag(CASE WHEN op = 'register' THEN version END) OVER w AS parent_version_id,
            count(*) FILTER (WHERE op = 'remove') OVER (PARTITION BY name ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
              + CASE WHEN op = 'remove' THEN 1 ELSE 0 END AS removals_from_here
            FROM e WINDOW w AS (PARTITION BY name ORDER BY seq))
        SELECT seq, op, CASE WHEN op = 'register' THEN version END AS version_id, parent_version_id,
            removals_from_here = 0 AS is_open FROM p""",
    ),
    "schema_differences": (
        schema_differences,
        """SELECT event_id, path, change, before, after FROM events JOIN (VALUES
            ('signup', 'id', 'widened', 'int', 'bigint'),
            ('error', 'id', 'narrowed', 'int', 'smallint'), ('error', 'note', 'removed', 'string', NULL),
            ('click', 'item.price', 'widened', 'float', 'double'), ('click', 'item.tags[]', 'widened', 'int', 'bigint'),
            ('click', 'item.unit', 'added', NULL, 'string'), ('click', 'extra', 'added', NULL, 'decimal(10,2)'),
            ('purchase', 'note', 'moved', '3', '0'), ('purchase', 'id', 'moved', '0', '1'),
            ('purchase', 'at', 'moved', '1', '2'), ('purchase', 'item', 'moved', '2', '3'),
            ('view', 'at', 'retyped', 'date', 'string'), ('view', 'note', 'nullability', 'nullable', 'not null')
        ) AS d(event_type, path, change, before, after) USING (event_type)""",
    ),
    "ipc_uint64_round_trip": (
        ipc_uint64_round_trip,
        f"SELECT l_orderkey, l_linenumber, (l_partkey::HUGEINT + {2**63})::VARCHAR AS u64 FROM lineitem",
    ),
    "ipc_empty_round_trip": (ipc_empty_round_trip, "SELECT 0::BIGINT AS row_count, 6 AS column_count"),
}
