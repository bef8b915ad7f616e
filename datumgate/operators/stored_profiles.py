"""Profiles of growing Parquet datasets from stored states, one per file.

A state is kept under the file's path and fingerprint. The profile of a dataset folds the states of the files its manifest
names, so files that stay are never read again and files that went leave with their states: bounds
need no second look, as no bound is ever taken back from a merged state.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidFormat, SchemaMismatch
from ..model import PARQUET
from ..sources.files import decoded_path, require_path
from ..sources.generations import newest
from ..sources.scan import detect
from .manifests import Manifests, listed_files
from .profile import column_states, merge_states

# Paths of one read: Spark takes them from the driver.
PATHS_PER_READ = 10_000
# Position of the row that says a file was profiled, whether it has rows or not.
_SEEN = -2
_FILE = ["dataset", "relative_path", "fingerprint"]


class StoredProfiles:
    """States below ``path``, and the manifests that say which of them count."""

    def __init__(self, spark: SparkSession, path: str, manifests: Manifests):
        self.spark = spark
        self.path = path.rstrip("/")
        self.manifests = manifests

    def states(self) -> DataFrame | None:
        """All states written so far, also of files that went; None before the first."""
        last = newest(self.spark, self.path)
        return None if last < 0 else self.spark.read.parquet(*[f"{self.path}/{n}" for n in range(last + 1)])

    def pending(self, root: str) -> DataFrame:
        """``(relative_path, fingerprint)`` of the files of the dataset that have no state yet."""
        files = self._files(root)
        states = self.states()
        return files if states is None else files.join(states.where(f"position = {_SEEN}"), _FILE, "left_anti")

    def _files(self, root: str) -> DataFrame:
        return self.manifests.files().where(F.col("dataset") == root).select(*_FILE)

    def profile(self, source: str) -> DataFrame:
        """The profile of the dataset at ``source`` as ``profile_columns`` gives it, with distinct counts from sketches.

        Brings the manifest up to the files there are, reads those without a state, and folds. Keys of folders
        named ``key=value`` are in no file and not profiled. Only Parquet: text has its types from the whole
        dataset, so that states of its files do not add up.
        """
        if (found := detect(self.spark, source)) != PARQUET:
            raise InvalidFormat(f"Stored profiles are for Parquet; {source} is {found}")
        root = require_path(self.spark, source).rstrip("/")
        listed = listed_files(self.spark, root)
        self.manifests.update(listed, self.spark.range(1).select(F.lit(root).alias("dataset")))
        schema = self.spark.read.option("recursiveFileLookup", "true").parquet(root).schema
        for files in _blocks(self.pending(root), PATHS_PER_READ):
            self._add(root, files, schema)
        states = self.states().join(self._files(root), _FILE, "left_semi").where("position >= 0").drop(*_FILE)
        # Columns are known even where no file has a row.
        none = column_states(self.spark.createDataFrame([], schema), sketches=True)
        return merge_states(states.unionByName(none))

    def _add(self, root: str, files: list[tuple[str, str]], schema: T.StructType) -> None:
        """Profiles some files in one pass, a group for each, and writes their states as the next folder."""
        paths = [f"{root}/{relative}" if relative else root for relative, _ in files]
        named = self.spark.createDataFrame(
            [(root, r, f, p) for (r, f), p in zip(files, paths, strict=True)],
            "dataset string, relative_path string, fingerprint string, part_path string",
        )
        rows = self.spark.read.parquet(*paths)
        if rows.schema != schema:
            raise SchemaMismatch(f"{root}: {files[0][0]!r} has other columns than the dataset")
        by_file = rows.withColumn("part_path", decoded_path(F.col("_metadata.file_path")))
        states = column_states(by_file, by=["part_path"], sketches=True)
        seen = named.select("part_path", F.lit(_SEEN).alias("position"))
        # The URI of a file and its path may differ in the slashes after the scheme.
        key = F.regexp_replace("part_path", "^file:/+", "file:/")
        keyed = states.unionByName(seen, allowMissingColumns=True).withColumn("part_path", key)
        joined = keyed.join(named.withColumn("part_path", key), "part_path").drop("part_path")
        joined.write.mode("overwrite").parquet(f"{self.path}/{newest(self.spark, self.path) + 1}")


def _blocks(files: DataFrame, size: int) -> Iterator[list[tuple[str, str]]]:
    rows = files.select("relative_path", "fingerprint").toLocalIterator()
    while block := [tuple(r) for r in islice(rows, size)]:
        yield block
