"""What grows: manifests, stored profiles, registry snapshots; and work that is cancelled."""

from __future__ import annotations

import os
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from datumgate.cancellation import Cancellation
from datumgate.errors import Cancelled, DatasetNotFound, InvalidFormat, SchemaMismatch
from datumgate.functions.ordered import with_place
from datumgate.model import IngestionSource
from datumgate.operators import manifests as manifests_module
from datumgate.operators.identity import directory_fingerprint
from datumgate.operators.ingest import ingest
from datumgate.operators.manifests import Manifests, listed_files
from datumgate.operators.profile import profile_columns
from datumgate.operators.registry import Registry
from datumgate.operators.stored_profiles import StoredProfiles

from .test_registry import entry


def berths(first: int, count: int) -> pa.Table:
    ids = list(range(first, first + count))
    return pa.table({"berth": pa.array(ids, pa.int64()), "ship": pa.array([f"ship-{i % 7}" if i % 5 else None for i in ids])})


@pytest.fixture
def harbour(tmp_path):
    folder = tmp_path / "harbour"
    (folder / "deep").mkdir(parents=True)
    pq.write_table(berths(0, 40), folder / "a.parquet")
    pq.write_table(berths(40, 60), folder / "deep" / "b c.parquet")
    return folder


def moves(update, name=None):
    return {r.dataset: (r.came, r.went) for r in update.collect()}


def fingerprint(manifests, spark, folder):
    root = listed_files(spark, str(folder)).first().dataset
    return {r.dataset: r for r in manifests.totals().collect()}[root]


def test_manifest_follows_changes(spark, harbour, tmp_path, monkeypatch):
    manifests = Manifests(spark, str(tmp_path / "manifests"), whole_every=3)
    hashed = []
    whole = manifests_module.stream_fingerprints

    def watched(files):
        hashed.append(sorted(os.path.basename(r.path) for r in files.select("path").collect()))
        return whole(files)

    monkeypatch.setattr(manifests_module, "stream_fingerprints", watched)

    def step(expected, names):
        hashed.clear()
        [found] = moves(manifests.update(listed_files(spark, str(harbour)))).values()
        assert found == expected and hashed[0] == names
        full = directory_fingerprint(spark, str(harbour)).first()
        now = fingerprint(manifests, spark, harbour)
        assert (now.fingerprint, now.file_count, now.byte_size) == (full.fingerprint, full.file_count, full.byte_size)

    step((2, 0), ["a.parquet", "b c.parquet"])
    step((0, 0), [])
    pq.write_table(berths(100, 5), harbour / "c.parquet")
    step((1, 0), ["c.parquet"])
    pq.write_table(berths(200, 6), harbour / "a.parquet")
    os.remove(harbour / "c.parquet")
    step((1, 2), ["a.parquet"])
    # Beyond a whole list.
    pq.write_table(berths(300, 7), harbour / "d.parquet")
    step((1, 0), ["d.parquet"])
    assert manifests.generation() == 3
    assert {r.relative_path for r in manifests.files(0).collect()} == {"a.parquet", "deep/b c.parquet"}
    assert {r.relative_path for r in manifests.files(1).collect()} == {"a.parquet", "deep/b c.parquet", "c.parquet"}
    assert {r.relative_path for r in manifests.files().collect()} == {"a.parquet", "deep/b c.parquet", "d.parquet"}


def test_unfinished_generation_is_written_again(spark, harbour, tmp_path):
    manifests = Manifests(spark, str(tmp_path / "manifests"))
    manifests.update(listed_files(spark, str(harbour)))
    # A call that died after its changes: they do not count.
    pq.write_table(berths(100, 5), harbour / "c.parquet")
    manifests.update(listed_files(spark, str(harbour)))
    os.remove(tmp_path / "manifests" / "totals" / "1" / "_SUCCESS")
    assert manifests.generation() == 0 and manifests.files().count() == 2
    manifests.update(listed_files(spark, str(harbour)))
    assert manifests.generation() == 1 and manifests.files().count() == 3
    assert fingerprint(manifests, spark, harbour).fingerprint == directory_fingerprint(spark, str(harbour)).first().fingerprint


def test_emptied_datasets_and_single_files(spark, harbour, tmp_path):
    manifests = Manifests(spark, str(tmp_path / "manifests"))
    single = str(harbour / "a.parquet")
    manifests.update(listed_files(spark, str(harbour)).union(listed_files(spark, single)))
    assert fingerprint(manifests, spark, single).fingerprint == directory_fingerprint(spark, single).first().fingerprint
    names = listed_files(spark, str(harbour)).select("dataset").distinct()
    found = moves(manifests.update(listed_files(spark, str(harbour)).limit(0), names))
    assert list(found.values()) == [(0, 2)]
    root = names.first().dataset
    assert {r.dataset: r.file_count for r in manifests.totals().collect()} == {root: 0, f"{root}/a.parquet": 1}


def test_ingest_with_manifests_gives_the_full_fingerprints(spark, harbour, tmp_path):
    manifests = Manifests(spark, str(tmp_path / "manifests"))
    sources = [
        IngestionSource("harbour", str(harbour)),
        IngestionSource("twice", str(harbour)),
        IngestionSource("deep", str(harbour / "deep")),
        IngestionSource("one", str(harbour / "a.parquet")),
    ]

    def prints(label, **options):
        registry = Registry(spark, str(tmp_path / label))
        return {r.name: (r.fingerprint, r.row_count) for r in ingest(spark, registry, sources, **options).collect()}

    assert prints("one", manifests=manifests) == prints("two")
    pq.write_table(berths(100, 5), harbour / "deep" / "c.parquet")
    assert prints("three", manifests=manifests) == prints("four")
    # The new file belongs to two of the datasets.
    assert manifests.files().where("relative_path like '%c.parquet'").count() == 4


def test_stored_profile_reads_new_files_only(spark, harbour, tmp_path, monkeypatch):
    stored = StoredProfiles(spark, str(tmp_path / "states"), Manifests(spark, str(tmp_path / "manifests")))
    read = []
    add = stored._add
    monkeypatch.setattr(stored, "_add", lambda root, files, schema: (read.append(sorted(f for f, _ in files)), add(root, files, schema)))

    def step(names):
        read.clear()
        found = {r.column: r.asDict() for r in stored.profile(str(harbour)).collect()}
        assert sum(read, []) == names
        whole = spark.read.option("recursiveFileLookup", "true").parquet(str(harbour))
        for row in profile_columns(whole).collect():
            mine = found.pop(row.column)
            distinct = whole.agg(F.count_distinct(row.column)).first()[0]
            assert abs(mine.pop("distinct_count_approx") - distinct) <= max(1, 0.05 * distinct)
            assert mine == {k: v for k, v in row.asDict().items() if k != "distinct_count_approx"}
        assert not found

    step(["a.parquet", "deep/b c.parquet"])
    step([])
    pq.write_table(berths(1000, 5), harbour / "c.parquet")
    pq.write_table(berths(0, 0), harbour / "empty.parquet")
    step(["c.parquet", "empty.parquet"])
    # The largest value goes with its file, and no other file is read for the bound.
    os.remove(harbour / "c.parquet")
    step([])
    os.remove(harbour / "a.parquet")
    os.remove(harbour / "deep" / "b c.parquet")
    step([])
    pq.write_table(pa.table({"other": [1]}), harbour / "z.parquet")
    with pytest.raises(SchemaMismatch):
        stored.profile(str(harbour))


def test_stored_profiles_are_for_parquet(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    stored = StoredProfiles(spark, str(tmp_path / "states"), Manifests(spark, str(tmp_path / "manifests")))
    with pytest.raises(InvalidFormat):
        stored.profile(str(tmp_path / "x.csv"))


def test_snapshots_change_no_answer(spark, tmp_path):
    segmented = Registry(spark, str(tmp_path / "short"), "tests", calls_per_segment=2)
    plain = Registry(spark, str(tmp_path / "long"), "tests")
    for registry in (segmented, plain):
        for name in ("a", "b", "a"):
            registry.register(entry(spark, name))
        for name in ("a", "b"):
            registry.remove(registry.get_by_name(name).first().dataset_id)
        registry.register(entry(spark, "a", fingerprint="f"))
        registry.register(entry(spark, "c"))
    times = ["created_at", "updated_at"]
    rows = lambda registry: [r.asDict() for r in registry.list().drop(*times).collect()]
    assert rows(segmented) == rows(plain) and [r["name"] for r in rows(plain)] == ["a", "c"]
    assert [r.seq for r in segmented.log().orderBy("seq").collect()] == list(range(7))
    with pytest.raises(DatasetNotFound):
        segmented.get_by_name("b")
    # Lookups open the last snapshot and the one call after it; the history is still whole.
    files = segmented.states().inputFiles()
    assert not any("/segments/0/" in f or "/segments/1/" in f or "/segments/2/" in f for f in files)
    assert any("/snapshots/2/" in f for f in files) and any("/segments/3/" in f for f in files)
    gone = segmented.log().where("op = 'remove' and name = 'a'").first().dataset_id
    assert segmented.log().where(F.col("dataset_id") == gone).count() == 3
    # A removal known from a snapshot alone still counts for the next identifier.
    assert segmented.get_by_name("a").first().dataset_id != gone


def test_a_snapshot_that_was_not_finished_is_not_read(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "log"), "tests", calls_per_segment=2)
    registry.register(entry(spark, "a"))
    registry.register(entry(spark, "b"))
    os.remove(tmp_path / "log" / "snapshots" / "0" / "_SUCCESS")
    assert {r.name for r in registry.list().collect()} == {"a", "b"}
    registry.register(entry(spark, "c"))
    assert {r.name for r in registry.list().collect()} == {"a", "b", "c"}
    assert not any("/segments/" in f for f in registry.states().inputFiles())


def test_row_counts_number_without_gaps(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "log"), "tests")
    rows = spark.range(9).select(F.col("id").alias("ord"), F.concat(F.lit("n"), "id").alias("name"))
    registry.register(entry(spark).drop("ord", "name").crossJoin(rows))
    registry.update_row_counts(rows.select("name", F.lit(5).cast("bigint").alias("row_count")).repartition(5))
    assert [r.seq for r in registry.log().orderBy("seq").collect()] == list(range(18))
    placed = with_place(rows.repartition(4), "name", "place", width=2).orderBy("name").collect()
    assert [r.place for r in placed] == list(range(9))


class CancelledAt(Cancellation):
    """Cancels itself at the given check."""

    def __init__(self, spark, at):
        super().__init__(spark)
        self.left = at

    def check(self):
        self.left -= 1
        if self.left < 0:
            self.cancel()
        super().check()


@pytest.mark.parametrize("at", range(5))
def test_cancelled_ingest_leaves_the_log_unchanged(spark, harbour, tmp_path, at):
    registry = Registry(spark, str(tmp_path / "log"))
    ingest(spark, registry, [IngestionSource("before", str(harbour))])
    with pytest.raises(Cancelled):
        ingest(spark, registry, [IngestionSource("after", str(harbour))], cancellation=CancelledAt(spark, at))
    assert [r.name for r in registry.log().collect()] == ["before"]
    assert ingest(spark, registry, [IngestionSource("after", str(harbour))]).count() == 1


def test_running_jobs_are_interrupted(spark):
    work = Cancellation(spark)
    slow = F.udf(lambda i: __import__("time").sleep(60) or i, "bigint")
    timer = threading.Timer(3, work.cancel)
    timer.start()
    with pytest.raises(Cancelled):
        with work:
            spark.range(0, 8, 1, 2).select(slow("id").alias("x")).agg(F.sum("x")).collect()
    # The session and other work go on.
    assert spark.range(3).count() == 3
    with pytest.raises(Cancelled):
        with work:
            pass
