"""Dataset registry: an append-only log of events, and queries on it.

A log row registers a dataset under a name or removes it. Registering a known
name again adds a version to the same dataset; after a removal the name starts a
new dataset. The identifier comes from the registry, the name and how often the
name was removed before, so that running a lost task again, or two writers
meeting a new name at once, gives the same identifier.

The log is cut into segments. When a segment holds a given number of calls, the state
all events so far lead to is written as a snapshot and a new segment begins: lookups and registrations read the
last snapshot and the segment after it, whatever the number of events. History reads the whole log.

One writer at a time is assumed: plain files offer no compare-and-set for the
sequence numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DatasetNotFound
from ..functions.hashing import identifier
from ..functions.ordered import CHUNK, with_history, with_place
from ..model import PIPELINE_VERSION
from ..sources.files import qualified
from ..sources.generations import newest, subfolders
from .identity import version_id

REGISTER, REMOVE = "register", "remove"

LOG_SCHEMA = """
    seq bigint, op string, dataset_id string, name string, path string, format string,
    schema_json string, fingerprint string, row_count bigint, row_count_is_sampled boolean,
    byte_size bigint, version_id string, at timestamp, pipeline_version string
"""

_CARRIED = ("name", "path", "format", "fingerprint", "row_count", "byte_size", "version_id", "schema_json")


_SUMMARY = ("version_count", "created_at", "updated_at")

# Tasks that a single name's events are spread over.
SALTS = 8


# Calls of ``register`` and ``remove`` that a segment holds.
CALLS_PER_SEGMENT = 64

_STATE = ("dataset_id", "seq", "removed", *_CARRIED, "version_count", "created_at", "updated_at")


def _is_removal() -> Column:
    return F.col("op") == REMOVE


def _after_registration(value: Column) -> Column:
    """A value of the event before, if that event registered the same dataset."""
    return F.when(F.col("previous.op") == REGISTER, value)


def resolve(raw: DataFrame, namespace: str, *, width: int = CHUNK) -> DataFrame:
    """Raw events ``(seq, op, name, fingerprint, schema_json, ...)`` as resolved ones.

    Adds ``dataset_id``, ``version_id``, the parent's ``parent_version_id`` and
    ``parent_schema_json``, and ``is_open``: whether the dataset the event
    belongs to is still registered.
    """
    seen = with_history(raw, "name", "seq", ["op", "fingerprint", "schema_json"], _is_removal(), width=width)
    parent = version_id(F.col("previous.fingerprint"), F.col("previous.schema_json"))
    return seen.select(
        *raw.columns,
        identifier(F.lit(namespace), F.col("before"), F.col("name")).alias("dataset_id"),
        F.when(~_is_removal(), version_id(F.col("fingerprint"), F.col("schema_json"))).alias("version_id"),
        _after_registration(parent).alias("parent_version_id"),
        _after_registration(F.col("previous.schema_json")).alias("parent_schema_json"),
        (F.col("before") == F.col("total")).alias("is_open"),
    )


def resolve_stored(log: DataFrame, *, width: int = CHUNK) -> DataFrame:
    """Events of a written log, which hold their identifiers, as resolved ones."""
    seen = with_history(log, "dataset_id", "seq", ["op", "version_id", "schema_json"], _is_removal(), width=width)
    return seen.select(
        *log.columns,
        _after_registration(F.col("previous.version_id")).alias("parent_version_id"),
        _after_registration(F.col("previous.schema_json")).alias("parent_schema_json"),
        (F.col("total") == 0).alias("is_open"),
    )


def current(log: DataFrame) -> DataFrame:
    """Registered datasets with the state of their last registration."""
    return current_of_states(event_states(log))


def event_states(log: DataFrame) -> DataFrame:
    """Each event as the state that it alone leads to."""
    registered = F.col("op") == REGISTER
    at = F.when(registered, F.col("at"))
    return log.withColumns(
        {
            "removed": F.when(registered, F.lit(0)).otherwise(1),
            "version_count": F.when(registered, F.lit(1)).otherwise(0).cast("bigint"),
            "created_at": at,
            "updated_at": at,
        }
    ).select(*_STATE)


def current_of_states(states: DataFrame) -> DataFrame:
    """The datasets still registered, from states of snapshots and events."""
    return folded_states(states).select("dataset_id", *_CARRIED, *_SUMMARY)


def folded_states(states: DataFrame) -> DataFrame:
    """One state for each dataset still registered.

    Hash aggregates over numbers, not windows: one row per dataset and task,
    however many versions a dataset has. The last event, found by its number, is
    then joined back on (dataset, number), a key that no dataset can overfill.
    """
    folded = states.groupBy("dataset_id").agg(
        F.max(F.when(F.col("removed") == 0, F.col("seq"))).alias("seq"),
        F.sum("version_count").alias("version_count"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.max("removed").alias("removed"),
    )
    last = folded.where("removed = 0").drop("removed")
    held = states.where("removed = 0").select("dataset_id", "seq", *_CARRIED)
    return held.join(last, ["dataset_id", "seq"]).withColumn("removed", F.lit(0)).select(*_STATE)


def removals_of(states: DataFrame) -> DataFrame:
    """``(name, removals, seq)``: how often each name was removed, and the number of the last removal."""
    gone = states.where("removed > 0")
    return gone.groupBy("name").agg(F.sum("removed").alias("removals"), F.max("seq").alias("seq"))


def _summary(registered: Column) -> list[Column]:
    return [
        F.max(F.when(registered, F.col("seq"))).alias("seq"),
        F.count(F.when(registered, F.lit(1))).alias("version_count"),
        F.min(F.when(registered, F.col("at"))).alias("created_at"),
        F.max(F.when(registered, F.col("at"))).alias("updated_at"),
    ]


def current_of_raw(raw: DataFrame, namespace: str) -> DataFrame:
    """``current`` of raw events, without resolving every event first.

    Only events after a name's last removal count. The removals, one row per
    name, meet the registrations on (name, salt), so a name with a third of all
    events is spread over ``SALTS`` tasks.
    """
    gone = raw.where(_is_removal()).groupBy("name").agg(
        F.count(F.lit(1)).alias("removals"), F.max("seq").alias("last_removal")
    )
    salted = gone.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    registered = raw.where(F.col("op") == REGISTER)
    salt = F.pmod(F.col("seq"), F.lit(SALTS)).cast("int")
    events = registered.select("name", "seq", "at", salt.alias("salt")).join(salted, ["name", "salt"], "left")
    removals = F.coalesce("removals", F.lit(0))
    alive = events.where(F.col("last_removal").isNull() | (F.col("seq") > F.col("last_removal")))
    last = alive.groupBy("name", removals.alias("removals")).agg(*_summary(F.lit(True)))
    identity = identifier(F.lit(namespace), F.col("removals"), F.col("name")).alias("dataset_id")
    version = version_id(F.col("fingerprint"), F.col("schema_json")).alias("version_id")
    found = registered.drop("op", "at").join(last, ["name", "seq"])
    return found.select(identity, *[c for c in _CARRIED if c != "version_id"], version, *_SUMMARY)


def versions(resolved: DataFrame) -> DataFrame:
    """Version history of the datasets still registered, with each parent version.

    ``changed`` compares with the parent version, ``schema_changed`` with the
    parent's schema; both are false for a first version.
    """
    return resolved.where((F.col("op") == REGISTER) & F.col("is_open")).select(
        "dataset_id",
        "seq",
        "version_id",
        "parent_version_id",
        "schema_json",
        "at",
        F.coalesce(F.col("version_id") != F.col("parent_version_id"), F.lit(False)).alias("changed"),
        F.coalesce(F.col("schema_json") != F.col("parent_schema_json"), F.lit(False)).alias("schema_changed"),
        "parent_schema_json",
    )


def schema_drift(resolved: DataFrame) -> DataFrame:
    """Versions whose schema differs from the version before."""
    drifted = versions(resolved).where("schema_changed")
    return drifted.select("dataset_id", "seq", "version_id", "parent_version_id", "parent_schema_json", "schema_json")


class Registry:
    """The log at ``path``, on any file system that Spark and PyArrow open."""

    def __init__(
        self, spark: SparkSession, path: str, namespace: str | None = None, *, calls_per_segment: int = CALLS_PER_SEGMENT
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.namespace = namespace or path
        self.calls_per_segment = calls_per_segment

    def log(self) -> DataFrame:
        """All events as written."""
        return self._segments(subfolders(self.spark, f"{self.path}/segments"))

    def _segments(self, numbers: list[int]) -> DataFrame:
        places = [f"{self.path}/segments/{n}" for n in numbers if qualified(self.spark, f"{self.path}/segments/{n}")[1]]
        if not places:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(*places)

    def _segment(self) -> int:
        """The segment being written: as many snapshots were finished before it."""
        return newest(self.spark, f"{self.path}/snapshots") + 1

    def states(self) -> DataFrame:
        """The last snapshot's states and those of the events after it."""
        at = self._segment()
        tail = event_states(self._segments([at]))
        if at == 0:
            return tail
        snapshot = self.spark.read.schema(tail.schema).parquet(f"{self.path}/snapshots/{at - 1}")
        return snapshot.unionByName(tail)

    def _append(self, events: DataFrame) -> None:
        """Writes events as a folder of the segment, which is closed by a snapshot once it is full."""
        at = self._segment()
        place = f"{self.path}/segments/{at}"
        calls = subfolders(self.spark, place)
        # A call that died left no event in its folder, as Spark commits a write at its end.
        events.write.mode("append").parquet(f"{place}/{calls[-1] + 1 if calls else 0}")
        if len(calls) + 1 >= self.calls_per_segment:
            states = self.states()
            # A name keeps one row for all its removals, with a dataset that no event can name.
            gone = removals_of(states).select(
                F.concat(F.lit("removed:"), F.col("name")).alias("dataset_id"), "name", "seq", F.col("removals").cast("int").alias("removed")
            )
            snapshot = folded_states(states).unionByName(gone, allowMissingColumns=True)
            snapshot.write.mode("overwrite").parquet(f"{self.path}/snapshots/{at}")

    def events(self) -> DataFrame:
        """All events, with parents and ``is_open``."""
        return resolve_stored(self.log())

    def _next_seq(self) -> int:
        [row] = self.states().agg(F.max("seq").alias("seq")).collect()
        return 0 if row.seq is None else row.seq + 1

    def register(self, rows: DataFrame) -> DataFrame:
        """Append registrations and return them as stored, with their ``ord``.

        ``rows`` holds ``ord`` (a non-negative integer, unique in this call, that
        fixes the order) and ``name, path, format, schema_json, fingerprint,
        row_count, row_count_is_sampled, byte_size``.
        """
        start, segment = self._next_seq(), self._segment()
        removals = removals_of(self.states()).drop("seq")
        entries = rows.join(removals, "name", "left").select(
            (F.col("ord") + F.lit(start)).cast("bigint").alias("seq"),
            F.lit(REGISTER).alias("op"),
            identifier(F.lit(self.namespace), F.coalesce("removals", F.lit(0)), F.col("name")).alias("dataset_id"),
            "name",
            "path",
            "format",
            "schema_json",
            "fingerprint",
            "row_count",
            "row_count_is_sampled",
            "byte_size",
            version_id(F.col("fingerprint"), F.col("schema_json")).alias("version_id"),
            F.current_timestamp().alias("at"),
            F.lit(PIPELINE_VERSION).alias("pipeline_version"),
        )
        self._append(entries)
        return self._segments([segment]).where(F.col("seq") >= start).withColumn("ord", F.col("seq") - start)

    def get(self, dataset_id: str) -> DataFrame:
        """The registered dataset with this id; the filter reaches the files."""
        return self._one(self.states().where(F.col("dataset_id") == dataset_id), dataset_id)

    def get_by_name(self, name: str) -> DataFrame:
        return self._one(self.states().where(F.col("name") == name), name)

    @staticmethod
    def _one(states: DataFrame, wanted: str) -> DataFrame:
        found = current_of_states(states)
        if not found.limit(1).count():
            raise DatasetNotFound(wanted)
        return found

    def list(self) -> DataFrame:
        """All registered datasets, by name."""
        return self.current().orderBy("name")

    def current(self) -> DataFrame:
        return current_of_states(self.states())

    def versions(self, dataset_id: str) -> DataFrame:
        mine = self.log().where(F.col("dataset_id") == dataset_id)
        return versions(resolve_stored(mine)).orderBy("seq")

    def remove(self, dataset_id: str) -> DataFrame:
        """Append a removal; returns the dataset as it was."""
        [gone] = self.get(dataset_id).collect()
        row = self.spark.range(1).select(
            F.lit(self._next_seq()).cast("bigint").alias("seq"),
            F.lit(REMOVE).alias("op"),
            F.lit(dataset_id).alias("dataset_id"),
            F.lit(gone.name).alias("name"),
            F.current_timestamp().alias("at"),
            F.lit(PIPELINE_VERSION).alias("pipeline_version"),
        )
        full = self.spark.createDataFrame([], LOG_SCHEMA).unionByName(row, allowMissingColumns=True)
        self._append(full)
        return self.spark.createDataFrame([gone])

    def update_row_counts(self, counted: DataFrame) -> DataFrame:
        """Record row counts found by profiling as new versions of light registrations.

        ``counted`` is ``(name, row_count)``; the version id stays the same, as
        neither the bytes nor the schema changed.
        """
        known = self.current().drop("row_count")
        rows = known.join(counted, "name").select(*_CARRIED, F.lit(False).alias("row_count_is_sampled"))
        return self.register(with_place(rows, "name", "ord"))
