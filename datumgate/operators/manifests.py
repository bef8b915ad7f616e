"""Manifests: which files a dataset had at each generation, and fingerprints that follow their changes.

Each call that finds changes adds a generation: the files that came and went (a row with ``sign`` 1 or -1 each) and the
new totals of every dataset it touched. A folder's fingerprint is a sum over its files, so the totals of the generation
before, less what went, plus what came, give the value that hashing every file would; files that stayed
are not opened. Every ``whole_every`` generations the files still there are written out whole, so that a
reader needs the last whole list and the few generations after it.

A file stays while its path, size and modification time stay: a file rewritten with equal size within the
millisecond of its old time is not seen. One writer at a time is assumed, as for the registry. A call
that dies leaves an unfinished generation, which the next call overwrites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..functions.hashing import WORDS, digest_text, limb_sums, word_totals
from ..functions.local import local_frame
from ..session import scratch_dir
from ..sources.files import require_path
from ..sources.generations import newest
from .identity import stream_fingerprints

WHOLE_EVERY = 32

FILES = "dataset string, relative_path string, length bigint, modified_at timestamp, fingerprint string, sign int"
_FILE = ("dataset", "relative_path", "length", "modified_at", "fingerprint")
SUMS = [f"s{i}" for i in range(WORDS)]
TOTALS = "dataset string, file_count bigint, byte_size bigint, single string, generation int, " + ", ".join(
    f"{s} decimal(38,0)" for s in SUMS
)


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """Files a dataset is read from, as ``Manifests.update`` takes them; ``dataset`` is the root as Spark prints it."""
    full = require_path(spark, root).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(full).where("length > 0")
    relative = F.ltrim(F.substring("path", len(full) + 1, 2**31 - 1), F.lit("/"))
    return files.select(
        F.lit(full).alias("dataset"), "path", relative.alias("relative_path"), "length", F.col("modificationTime").alias("modified_at")
    )


class Manifests:
    """Generations below ``path``, on any file system that Spark and PyArrow open."""

    def __init__(self, spark: SparkSession, path: str, *, whole_every: int = WHOLE_EVERY):
        self.spark = spark
        self.path = path.rstrip("/")
        self.whole_every = whole_every

    def generation(self) -> int:
        """The last finished generation, -1 before the first."""
        # Totals are written last.
        return newest(self.spark, f"{self.path}/totals")

    def _since_whole(self, upto: int) -> tuple[int, list[str]]:
        """The last whole generation up to ``upto`` (or -1) and the folders of changes after it."""
        start = newest(self.spark, f"{self.path}/whole", upto)
        return start, [f"{self.path}/changes/{n}" for n in range(start + 1, upto + 1)]

    def files(self, generation: int | None = None) -> DataFrame:
        """``(dataset, relative_path, length, modified_at, fingerprint)`` of the files at a generation (the last)."""
        upto = self.generation() if generation is None else generation
        start, changed = self._since_whole(upto)
        parts = ([f"{self.path}/whole/{start}"] if start >= 0 else []) + changed
        if not parts:
            return local_frame(self.spark, [], FILES).drop("sign")
        rows = self.spark.read.schema(FILES).parquet(*parts)
        return rows.groupBy(*_FILE).agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")

    def totals(self) -> DataFrame:
        """Last totals of every dataset: the number and size of its files, the digest's sums, the fingerprint."""
        upto = self.generation()
        if upto < 0:
            return _with_fingerprint(local_frame(self.spark, [], TOTALS))
        start, _ = self._since_whole(upto)
        parts = [f"{self.path}/whole_totals/{start}"] if start >= 0 else []
        parts += [f"{self.path}/totals/{n}" for n in range(start + 1, upto + 1)]
        rows = self.spark.read.schema(TOTALS).parquet(*parts)
        names = [c for c in rows.columns if c != "dataset"]
        last = rows.groupBy("dataset").agg(F.max_by(F.struct(*names), "generation").alias("last"))
        return _with_fingerprint(last.select("dataset", "last.*"))

    def update(self, listed: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
        """Bring the manifests up to ``listed`` and return ``(dataset, came, went)``, the numbers of files hashed and dropped.

        ``listed`` is ``(dataset, path, relative_path, length, modified_at)``, one row per file of each dataset listed.
        ``datasets`` names those whose files are listed (as a column ``dataset``), where some may have no file left.
        """
        names = (listed if datasets is None else datasets).select("dataset").distinct()
        difference = self._difference(listed, names)
        came = difference.where("path is not null")
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # A number of tasks of its own: by their size alone the names would all go to one.
        hashed = stream_fingerprints(came.select("path", "length").distinct().repartition(tasks, "path")).drop("length")
        new = came.join(hashed, "path").select(*_FILE, F.lit(1).alias("sign"))
        old = difference.where("old_length is not null").select(
            "dataset", "relative_path", *[F.col(f"old_{c}").alias(c) for c in _FILE[2:]], F.lit(-1).alias("sign")
        )
        if difference.isEmpty():
            return _counted(local_frame(self.spark, [], FILES), names)
        upto = self.generation() + 1
        place = f"{self.path}/changes/{upto}"
        new.unionByName(old).write.mode("overwrite").parquet(place)
        changes = self.spark.read.schema(FILES).parquet(place)
        self._next_totals(changes, upto).write.mode("overwrite").parquet(f"{self.path}/totals/{upto}")
        if (upto + 1) % self.whole_every == 0:
            self._write_whole(upto)
        return _counted(changes, names)

    def _difference(self, listed: DataFrame, names: DataFrame) -> DataFrame:
        """Files that came (``path`` is set), went (``old_length`` is set) or changed (both), as a written table."""
        known = self.files().join(names, "dataset", "left_semi")
        known = known.select("dataset", "relative_path", *[F.col(c).alias(f"old_{c}") for c in _FILE[2:]])
        both = listed.join(known, ["dataset", "relative_path"], "full")
        same = (F.col("length") == F.col("old_length")) & (F.col("modified_at") == F.col("old_modified_at"))
        place = scratch_dir(self.spark, "difference")
        both.where(~F.coalesce(same, F.lit(False))).write.parquet(place)
        return self.spark.read.schema(both.schema).parquet(place)

    def _next_totals(self, changes: DataFrame, generation: int) -> DataFrame:
        """Totals after ``changes`` of the datasets they touch: sums of what came less sums of what went."""
        entry = F.sha2(F.concat_ws(":", "relative_path", "fingerprint"), 256)
        is_single = F.col("relative_path") == ""
        by_sign = changes.withColumn("entry", entry).groupBy("dataset", "sign").agg(
            F.count(F.lit(1)).alias("file_count"),
            F.sum("length").alias("byte_size"),
            F.max(F.when(is_single, F.col("fingerprint"))).alias("single"),
            F.count(F.when(is_single, F.lit(1))).alias("singles"),
            *limb_sums(F.col("entry")),
        )
        signed = by_sign.select("dataset", "sign", "file_count", "byte_size", "single", "singles", *word_totals())

        def net(name: str, kind: str) -> Column:
            return F.sum(F.col(name) * F.col("sign").cast(kind)).cast(kind).alias(f"d_{name}")

        delta = signed.groupBy("dataset").agg(
            net("file_count", "bigint"),
            net("byte_size", "bigint"),
            F.max(F.when(F.col("sign") == 1, F.col("single"))).alias("new_single"),
            F.sum("singles").alias("singles"),
            *[F.sum(F.when(F.col("sign") == 1, F.col(s)).otherwise(-F.col(s))).cast("decimal(38,0)").alias(f"d_{s}") for s in SUMS],
        )
        before = self.totals().drop("fingerprint", "generation")
        added = [
            (F.coalesce(F.col(n), F.lit(0)) + F.col(f"d_{n}")).cast("decimal(38,0)" if n in SUMS else "bigint").alias(n)
            for n in ("file_count", "byte_size", *SUMS)
        ]
        # The one file of a dataset is named by the empty path; a change of it replaces what was known.
        single = F.when(F.col("singles") > 0, F.col("new_single")).otherwise(F.col("single")).alias("single")
        columns = [c.split()[0] for c in TOTALS.split(", ")]
        joined = delta.join(before, "dataset", "left")
        return joined.select("dataset", *added, single, F.lit(generation).alias("generation")).select(*columns)

    def _write_whole(self, generation: int) -> None:
        totals = self.totals().drop("fingerprint")
        totals.write.mode("overwrite").parquet(f"{self.path}/whole_totals/{generation}")
        files = self.files(generation).withColumn("sign", F.lit(1))
        files.write.mode("overwrite").parquet(f"{self.path}/whole/{generation}")


def _with_fingerprint(totals: DataFrame) -> DataFrame:
    """Adds what ``manifest_fingerprints`` gives for all files of a dataset."""
    folder = digest_text(F.col("file_count"), *[ref(s) for s in SUMS])
    return totals.withColumn("fingerprint", F.coalesce("single", folder))


def _counted(changes: DataFrame, names: DataFrame) -> DataFrame:
    by_sign = changes.groupBy("dataset").agg(
        F.count(F.when(F.col("sign") == 1, F.lit(1))).alias("came"), F.count(F.when(F.col("sign") == -1, F.lit(1))).alias("went")
    )
    return names.join(by_sign, "dataset", "left").select(
        "dataset", F.coalesce("came", F.lit(0)).alias("came"), F.coalesce("went", F.lit(0)).alias("went")
    )
