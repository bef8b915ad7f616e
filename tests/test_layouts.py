"""Hive layouts in every format, and IPC streams split by their message headers."""

from __future__ import annotations

import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from datumgate.errors import CorruptedBatch, SchemaMismatch
from datumgate.model import IngestionSource
from datumgate.operators.ingest import inspect_sources
from datumgate.sources.arrow_ipc import read_ipc, write_ipc
from datumgate.sources.files import open_file
from datumgate.sources.footers import ipc_row_count
from datumgate.sources.ipc_spans import batch_places, stream_spans
from datumgate.sources.scan import scan

KEYS = ["day", "n", "who"]


def _layouts(spark, tmp_path):
    """One Hive layout in three formats: keys of three types, one of them with a blank, a slash and a null."""
    rows = [(i, f"r{i}", f"2024-01-0{1 + i % 2}", i % 3, ["a b", "c/d", None][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, s string, day string, n int, who string")
    df.write.partitionBy(*KEYS).parquet(str(tmp_path / "parquet"))
    df.write.partitionBy(*KEYS).option("header", "true").csv(str(tmp_path / "csv"))
    for place in sorted((tmp_path / "parquet").glob("*/*/*")):
        rows = spark.read.parquet(str(place))
        write_ipc(rows.coalesce(1), str(tmp_path / "ipc" / place.relative_to(tmp_path / "parquet")))
    return {name: str(tmp_path / name) for name in ("parquet", "ipc", "csv")}


def test_one_layout_equal_in_every_format(spark, tmp_path):
    folders = _layouts(spark, tmp_path)
    parquet = scan(spark, folders["parquet"])
    expected = sorted(map(tuple, parquet.collect()), key=lambda r: r[0])
    assert len(expected) == 60 and isinstance(expected[0][2], datetime.date)
    for name in ("ipc", "csv"):
        found = scan(spark, folders[name])
        assert found.columns == parquet.columns == ["id", "s", *KEYS]
        assert [f.dataType for f in found.schema] == [f.dataType for f in parquet.schema]
        assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == expected
        assert scan(spark, folders[name], columns=["who", "id"]).columns == ["who", "id"]
    assert scan(spark, folders["ipc"], columns=["who"]).where("who is null").count() == 20
    facts = inspect_sources(spark, [IngestionSource(n, p) for n, p in folders.items()]).collect()
    assert {r.schema_json for r in facts} == {parquet.schema.json()} and {r.row_count for r in facts} == {60}


@pytest.mark.parametrize(
    ("condition", "count"),
    [
        ("n = 1", 20), ("n <> 1 and day = date'2024-01-01'", 20), ("who is null", 20), ("who like 'a%'", 20),
        ("not (who = 'a b')", 20), ("n in (0, 2)", 40), ("who <=> null", 20), ("n + 1 = 1", 20), ("n > 7", 0),
    ],
)
def test_filters_on_keys(spark, layouts, condition, count):
    for path in layouts.values():
        assert scan(spark, path, where=F.expr(condition)).count() == count


@pytest.fixture(scope="module")
def layouts(spark, tmp_path_factory):
    return _layouts(spark, tmp_path_factory.mktemp("layouts"))


def test_refused_keys_open_no_file(spark, tmp_path):
    for key in ("x", "y"):
        write_ipc(spark.range(10), str(tmp_path / f"k={key}"))
    for path in (tmp_path / "k=y").glob("*.arrow"):
        path.write_bytes(b"no longer an IPC file" * 9)
    kept = scan(spark, str(tmp_path), where=F.col("k") < "y")
    assert kept.count() == 10 and kept.columns == ["id", "k"]
    assert kept.where("id > 4").union(kept.where("id < 3")).count() == 8
    with pytest.raises(CorruptedBatch):
        scan(spark, str(tmp_path))


def test_text_scan_filters_keys_itself(spark, layouts):
    plan = scan(spark, layouts["csv"]).where("n = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(n" in plan


def test_keys_called_as_stored_columns_are_refused(spark, tmp_path):
    write_ipc(spark.range(3), str(tmp_path / "ipc" / "ID=1"))
    spark.range(3).write.option("header", "true").csv(str(tmp_path / "csv" / "id=1"))
    for name in ("ipc", "csv"):
        with pytest.raises(SchemaMismatch, match="key of their folders"):
            scan(spark, str(tmp_path / name))
    (row,) = inspect_sources(spark, [IngestionSource("t", str(tmp_path / "ipc"))]).collect()
    assert row.error_code == "SchemaMismatch"
    # A key may be called as the engine calls a line, but not as the listing calls its columns.
    spark.range(3).write.option("header", "true").csv(str(tmp_path / "lines" / "line=7"))
    assert scan(spark, str(tmp_path / "lines")).agg(F.sum("line")).first()[0] == 21
    write_ipc(spark.range(3), str(tmp_path / "listed" / "length=7"))
    with pytest.raises(Exception, match="column of the listing"):
        scan(spark, str(tmp_path / "listed"))


def _stream(path, batches, layout=pa.ipc.new_stream, **options):
    with pa.OSFile(str(path), "wb") as sink, layout(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(**options)) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return str(path)


@pytest.mark.parametrize("options", [{}, {"compression": "zstd"}, {"use_legacy_format": True}])
@pytest.mark.parametrize("layout", [pa.ipc.new_stream, pa.ipc.new_file])
def test_places_without_bodies(tmp_path, layout, options):
    sizes = [5, 0, 1000, 1, 77]
    batches = [pa.record_batch({"v": range(n), "s": ["x" * k for k in range(n)]}, pa.schema([("v", pa.int64()), ("s", pa.string())])) for n in sizes]
    path = _stream(tmp_path / "f", batches, layout, **options)
    with open_file(path) as source:
        assert [p.rows for p in batch_places(source)] == sizes
        assert ipc_row_count(source, batches[0].schema) == sum(sizes)
        spans = list(stream_spans(source, 2000))
        assert sum(rows for _, _, rows in spans) == sum(sizes) and len(spans) > 1


def test_split_stream_equals_whole(spark, tmp_path):
    batches = [pa.record_batch({"v": range(k * 100, k * 100 + 100), "s": [f"t{i}" for i in range(100)]}) for k in range(30)]
    path = _stream(tmp_path / "s.arrow", batches)
    split = read_ipc(spark, path, partition_bytes=4000)
    assert sorted(r.v for r in split.collect()) == list(range(3000))
    assert split.select(F.spark_partition_id()).distinct().count() > 3
    assert read_ipc(spark, path, partition_bytes=4000, columns=["s"]).where("s = 't7'").count() == 30


def test_cut_and_broken_streams(spark, tmp_path):
    path = tmp_path / "cut.arrow"
    _stream(path, [pa.record_batch({"v": range(500)})] * 3)
    whole = path.read_bytes()
    for broken in (whole[: len(whole) - 2000], whole[: len(whole) // 2] + b"\x07" * (len(whole) // 2)):
        path.write_bytes(broken)
        with open_file(str(path)) as source, pytest.raises(pa.ArrowInvalid):
            list(batch_places(source))
        with pytest.raises(Exception, match="CorruptedBatch"):
            read_ipc(spark, str(path), partition_bytes=1000).collect()
    (row,) = inspect_sources(spark, [IngestionSource("cut", str(path))]).collect()
    assert row.error_code == CorruptedBatch.code
