"""File listings, format detection and file bytes."""

from __future__ import annotations

from pathlib import PurePosixPath
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaMismatch, SourceIoError
from ..functions.columns import ref
from ..functions.local import local_frame
from ..model import EXTENSIONS, MAGIC
from ..session import scratch_dir


def filesystem_of(uri: str):
    """File system and path behind a path as Spark prints it. Runs inside tasks."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon else uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def open_file(uri: str) -> pa.NativeFile:
    """Random-access file. Runs inside tasks."""
    filesystem, path = filesystem_of(uri)
    return filesystem.open_input_file(path)


# Columns of the listing, which no partition key may be called.
_LISTED = ("path", "modificationTime", "length", "content")


def list_files(spark: SparkSession, paths: str | list[str], keyed: bool = False) -> DataFrame:
    """``(path, length)`` of every file; contents are not read.

    Spark's file scans plan no reads for empty files, so those are not listed. With ``keyed`` the keys of
    folders named ``key=value`` follow, typed as Spark's file scans type them.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", str(not keyed).lower())
    files = listing.load([paths] if isinstance(paths, str) else list(paths))
    keys = [name for name in files.columns if name not in _LISTED]
    if keyed:
        # Spark gives such a key the place of the listing's own column.
        taken = F.exists(F.split("path", "/"), lambda part: F.split_part(part, F.lit("="), F.lit(1)).isin(*_LISTED))
        message = "a partition key is called as a column of the listing: " + ", ".join(_LISTED)
        files = files.where(F.when(taken, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))
    return files.select("path", "length", *[ref(k) for k in keys])


def key_fields(spark: SparkSession, root: str) -> list[T.StructField]:
    """The partition keys of a dataset, from its folders' names."""
    return list_files(spark, root, keyed=True).schema.fields[2:]


def with_keys(stored: T.StructType, keys: T.StructType, source: str) -> T.StructType:
    """The stored columns and the partition keys behind them; a name may be used once, whatever its case."""
    held = {name.lower() for name in stored.names}
    both = [name for name in keys.names if name.lower() in held]
    if both:
        raise SchemaMismatch(f"{source}: {both[0]!r} is a column of the files and the key of their folders")
    return T.StructType(stored.fields + keys.fields)


def outermost(roots: list[str]) -> list[str]:
    """Distinct roots without those that lie below another one."""
    known = set(roots)
    kept = []
    for root in sorted(known):
        parts = root.split("/")
        if not any("/".join(parts[:i]) in known for i in range(1, len(parts))):
            kept.append(root)
    return kept


def outer_roots(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The paths as Spark prints them, without those below another; raises where one is absent."""
    return outermost([require_path(spark, p).rstrip("/") for p in ([paths] if isinstance(paths, str) else paths)])


def walk_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(root, path, length)`` of every file below the paths: empty ones and hidden ones (``_``, ``.``) too.

    Spark's file scans leave those out. Here the folders of one depth are listed in tasks, a folder in each row,
    and the folders found are the next depth, until there are none. Each depth is a written table; the
    driver holds the caller's paths only.
    """
    roots = outer_roots(spark, paths)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def entries(uri: str) -> list[tuple]:
        from pyarrow import fs

        filesystem, place = filesystem_of(uri)
        info = filesystem.get_file_info(place)
        if info.type == fs.FileType.File:
            return [(uri, info.size, False)]
        found = filesystem.get_file_info(fs.FileSelector(place))
        return [(f"{uri}/{f.base_name}", f.size, f.type == fs.FileType.Directory) for f in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, path in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                found = entries(path)
                columns = [[root] * len(found), *([f[k] for f in found] for k in range(3))]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_())
                arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["root", "path", "length", "is_folder"])

    folders = local_frame(spark, [(r, r) for r in roots], "root string, path string")
    depths = []
    while True:
        depths.append(scratch_dir(spark, "listing"))
        # A number of tasks of its own: by their size alone the names would all go to one.
        spread = folders.repartition(tasks, "path")
        spread.mapInArrow(run, "root string, path string, length bigint, is_folder boolean").write.parquet(depths[-1])
        folders = spark.read.parquet(depths[-1]).where("is_folder").select("root", "path")
        if folders.isEmpty():
            break
    return spark.read.parquet(*depths).where("not is_folder").select("root", "path", "length")


def is_hidden(root: Column, path: Column) -> Column:
    """Whether a file, or a folder between it and ``root``, has a name that begins with ``_`` or ``.``."""
    below = F.when(path == root, file_name(path)).otherwise(F.substr(path, F.length(root) + 2))
    return F.exists(F.split(below, "/"), lambda part: part.rlike("^[_.]"))


def is_partitioned(relative_path: Column) -> Column:
    """Whether a file lies below a folder named ``key=value``, as in a Hive layout."""
    return F.exists(F.split(relative_path, "/"), lambda part: part.rlike("^[^=]+=")) & relative_path.contains("/")


def decoded_path(file_path: Column) -> Column:
    """``_metadata.file_path``, which is a URI, as the listing prints it."""
    return F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def format_by_extension(path: Column) -> Column:
    """Format named by the file extension, null when it says nothing."""
    extension = F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))
    chosen = F.lit(None).cast("string")
    for name, extensions in EXTENSIONS.items():
        chosen = F.when(extension.isin(*extensions), F.lit(name)).otherwise(chosen)
    return chosen


def format_by_magic(lead: Column) -> Column:
    """Format named by the leading bytes (binary column), null when unknown."""
    chosen = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        chosen = F.when(F.substring(lead, 1, len(magic)) == F.lit(bytearray(magic)), F.lit(name)).otherwise(chosen)
    return chosen


def leading_bytes(files: DataFrame, count: int = 8) -> DataFrame:
    """``(path, length, lead)``: the first bytes of each file, read in the tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = []
            for path in batch.column("path").to_pylist():
                with open_file(path) as source:
                    leads.append(source.read(count))
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("length"), pa.array(leads, pa.binary())],
                names=["path", "length", "lead"],
            )

    return files.select("path", "length").mapInArrow(read, "path string, length bigint, lead binary")


def detect_formats(files: DataFrame) -> DataFrame:
    """``(path, length, format)``; format is null when it cannot be told.

    The extension decides without opening the file. Only the others are opened,
    for their first bytes.
    """
    named = files.withColumn("format", format_by_extension(F.col("path")))
    known = named.where("format is not null")
    probed = leading_bytes(named.where("format is null"))
    return known.unionByName(probed.select("path", "length", format_by_magic(F.col("lead")).alias("format")))


def qualified(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The path as Spark prints it, and whether it is there."""
    filesystem, hadoop_path = _hadoop(spark, path)
    return filesystem.makeQualified(hadoop_path).toString(), bool(filesystem.exists(hadoop_path))


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def require_path(spark: SparkSession, path: str) -> str:
    full, there = qualified(spark, path)
    if not there:
        raise SourceIoError(f"No such source: {path}")
    return full


def first_file(spark: SparkSession, path: str) -> str | None:
    """The path itself when it is a file, else the first non-empty file below it."""
    filesystem, hadoop_path = _hadoop(spark, path)
    if filesystem.getFileStatus(hadoop_path).isFile():
        return path
    [first] = list_files(spark, path).where("length > 0").agg(F.min("path").alias("path")).collect()
    return first.path


def detect_file(path: str) -> str | None:
    """Format of one file, on the driver: by extension, else by its first bytes."""
    extension = PurePosixPath(path).suffix[1:].lower()
    for name, extensions in EXTENSIONS.items():
        if extension in extensions:
            return name
    with open_file(path) as source:
        lead = source.read(8)
    return next((name for name, magic in MAGIC.items() if lead.startswith(magic)), None)
