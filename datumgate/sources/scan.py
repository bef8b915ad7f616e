"""One entry point for reading a dataset, whatever its format."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidFormat, UnsupportedDataType, error_for
from ..functions.columns import ntz_from_micros, ref
from ..functions.types import STORED_TYPE, unsupported_message
from ..model import ARROW_IPC, CSV, PARQUET, CsvOptions
from ..operators.infer import load_delimited
from .arrow_ipc import read_ipc
from .files import detect_file, detect_formats, first_file, list_files, require_path
from .footers import dataset_facts, inspect_footer
from .verify import require_sound

NANOS_AS_LONG = "spark.sql.legacy.parquet.nanosAsLong"


def detect(spark: SparkSession, path: str) -> str:
    """Format of a file, or of the files of a folder when they agree."""
    if first_file(spark, path) == path:
        found = [detect_file(path)]
    else:
        # Formats are few, whatever the number of files.
        files = list_files(spark, path).where("length > 0")
        found = [r.format for r in detect_formats(files).select("format").distinct().collect()]
    if len(found) != 1 or found[0] is None:
        raise InvalidFormat(f"Cannot tell the storage format of {path}")
    return found[0]


def csv_options(spark: SparkSession, path: str, options: CsvOptions | None = None) -> CsvOptions:
    """Given options, or the defaults with the delimiter that the file names call for."""
    if options is not None:
        return options
    name = first_file(spark, path) or path
    return CsvOptions(delimiter="\t") if name.lower().endswith(".tsv") else CsvOptions()


def stated_facts(spark: SparkSession, root: str, fmt: str, where: Column | None = None) -> Row:
    """The dataset's row of ``dataset_facts``: one job over the headers of all its files.

    ``where``, a condition on partition keys, leaves out files; where it leaves none, all are looked at.

    The header of a dataset that is one file is read without a job.
    """
    if first_file(spark, root) == root:
        facts = inspect_footer(root, fmt, counts=False)
        if facts["error_code"] is not None:
            raise error_for(facts["error_code"], facts["error_message"])
        return Row(schema_json=facts["schema_json"], partitioned=False)
    relative = F.ltrim(F.substring("path", len(root) + 1, 2**31 - 1), F.lit("/"))
    files = list_files(spark, root, keyed=where is not None).where("length > 0")
    kept = files if where is None else files.where(where)
    named = kept.select("path", F.lit(fmt).alias("format"), F.lit(0).alias("key"))
    found = dataset_facts(named.withColumn("relative_path", relative), "key", counts=False).collect()
    if not found and where is not None:
        return stated_facts(spark, root, fmt)
    if not found:
        raise InvalidFormat(f"No data in {root}")
    if found[0].error_code is not None:
        raise error_for(found[0].error_code, f"{root}: {found[0].error_message}")
    return found[0]


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows of ``open_parquet``."""
    return open_parquet(spark, path)[0]


def open_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Parquet rows under the contract, which is checked before any row is read.

    A dataset is every file below the path, and all must state one schema, as in
    ingestion; folders named ``key=value`` add their keys as columns. Footers
    tell unsigned 64-bit columns from decimals and show types that Spark reads as
    others, which the fields keep as metadata. Nanosecond timestamps are read as
    integers and floored to microseconds. Also tells whether partition folders were found.
    """
    root = require_path(spark, path).rstrip("/")
    facts = stated_facts(spark, root, PARQUET)
    stored = {
        f["name"]: f["metadata"][STORED_TYPE]
        for f in json.loads(facts.schema_json)["fields"]
        if STORED_TYPE in f["metadata"]
    }
    if any("Timestamp(Nanosecond" in name for name in stored.values()):
        # A session of its own: the caller's other reads must not change.
        spark = spark.newSession()
        spark.conf.set(NANOS_AS_LONG, "true")
    df = read_parquet(spark, root, facts.partitioned)
    if stored:
        df = df.select(*[_as_stored(f, stored.get(f.name)) for f in df.schema.fields])
    return df, facts.partitioned


def read_parquet(spark: SparkSession, root: str, partitioned: bool) -> DataFrame:
    """All Parquet files below a folder; partition folders become columns."""
    return spark.read.option("recursiveFileLookup", str(not partitioned).lower()).parquet(root)


def _as_stored(field: T.StructField, stored: str | None) -> Column:
    """The column with its stored type as metadata; nanoseconds become microseconds."""
    if stored is None:
        return ref(field.name)
    if "Timestamp(Nanosecond" in stored and not stored.startswith("Timestamp("):
        raise UnsupportedDataType(unsupported_message(field.name, stored))
    col = _with_micros(field, stored) if stored.startswith("Timestamp(Nanosecond") else ref(field.name)
    return col.alias(field.name, metadata={STORED_TYPE: stored})


def _with_micros(field: T.StructField, stored: str) -> Column:
    """The column, with nanoseconds (read as integers) floored to microseconds."""
    col = ref(field.name)
    micros = F.floor(col.cast("decimal(20,0)") / F.lit(1000).cast("decimal(4,0)")).cast("bigint")
    return (ntz_from_micros(micros) if stored.endswith("None)") else F.timestamp_micros(micros))


def scan(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    *,
    csv: CsvOptions | None = None,
    columns: list[str] | None = None,
    where: Column | None = None,
    sample_limit: int | None = None,
    verify: bool = False,
) -> DataFrame:
    """Rows of the dataset at ``path``. A given format wins over detection.

    Folders named ``key=value`` become columns behind the stored ones in every format. ``where`` is a condition on
    these keys, ``columns`` are the only ones read. Parquet and text scans follow a later ``where`` and
    ``select`` just as well; Arrow IPC files are spared by these two arguments only.

    ``verify=True`` decodes every Parquet row group and IPC batch first and raises ``CorruptedBatch``, which names
    file, part and column, before any row is handed out.
    """
    full = require_path(spark, path)
    fmt = fmt or detect(spark, full)
    if verify:
        require_sound(spark, list_files(spark, full).where("length > 0").select("path", F.lit(fmt).alias("format")))
    if fmt == PARQUET:
        df = scan_parquet(spark, full)
    elif fmt == ARROW_IPC:
        facts = stated_facts(spark, full.rstrip("/"), ARROW_IPC, where)
        df = read_ipc(spark, full, columns=columns, partitioned=facts.partitioned, where=where)
    elif fmt == CSV:
        facts = stated_facts(spark, full.rstrip("/"), CSV)
        df = load_delimited(spark, full, csv_options(spark, full, csv), partitioned=facts.partitioned)
    else:
        raise InvalidFormat(f"Cannot tell the storage format of {path}")
    if where is not None and fmt != ARROW_IPC:
        df = df.where(where)
    if columns is not None:
        df = df.select(*[ref(c) for c in columns])
    return df if sample_limit is None else df.limit(sample_limit)


def row_count(df: DataFrame, sample_limit: int | None = None) -> DataFrame:
    """``(row_count, row_count_is_sampled)``; under a limit every task stops once it is passed."""
    if sample_limit is not None:
        df = df.limit(sample_limit + 1)
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    if sample_limit is None:
        return counted.select(F.col("n").alias("row_count"), F.lit(False).alias("row_count_is_sampled"))
    return counted.select(
        F.least("n", F.lit(sample_limit)).cast("bigint").alias("row_count"),
        (F.col("n") > sample_limit).alias("row_count_is_sampled"),
    )
