from __future__ import annotations

import datetime as dt
import hashlib
import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datumgate.errors import CorruptedBatch, InvalidFormat, SchemaMismatch, SourceIoError, UnsupportedDataType
from datumgate.functions.cells import split_cells
from datumgate.functions.types import arrow_canonical, canonical_name
from datumgate.operators.contract import contract_report, require_canonical
from datumgate.operators.identity import (
    content_fingerprint,
    directory_fingerprint,
    file_fingerprints,
    register_files,
    version_id,
)
from datumgate.operators.ingest import ingest
from datumgate.operators.parquet_footers import profile_parquet
from datumgate.operators.profile import profile_columns
from datumgate.operators.registry import Registry
from datumgate.model import CsvOptions, IngestionOptions, IngestionSource
from datumgate.sources.arrow_ipc import deserialize, read_ipc, serialize, write_ipc
from datumgate.sources.files import detect_formats, list_files, walk_files
from datumgate.sources.footers import footer_contract
from datumgate.sources.scan import scan
from datumgate.sources.verify import check_files, require_sound

ISLANDS = pa.table(
    {"id": pa.array([9, 5, 7, 6], pa.int32()), "island": pa.array([None, "Fyn", "Als", "Mors"], pa.string())}
)


def write_file(table, path, layout="file", rows=None):
    new = pa.ipc.new_file if layout == "file" else pa.ipc.new_stream
    with pa.OSFile(str(path), "wb") as sink, new(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=rows)
    return str(path)


def test_contract_accepts(spark):
    schema = T._parse_datatype_string("id int, name string, ts timestamp_ntz")
    require_canonical(schema)
    report = contract_report(spark, {"t": spark.createDataFrame([], schema)}).collect()
    assert [(r.field, r.data_type, r.canonical) for r in report] == [
        ("id", "Int32", True),
        ("name", "Utf8", True),
        ("ts", "Timestamp(Microsecond, None)", True),
    ]


@pytest.mark.parametrize(
    "ddl", ["d decimal(10,2)", "m map<string,int>", "b binary", "a array<binary>", "s struct<x:array<decimal(5,1)>>"]
)
def test_contract_rejects_naming_the_top_field(spark, ddl):
    schema = T._parse_datatype_string("ok int, " + ddl)
    with pytest.raises(UnsupportedDataType, match=f"Field '{ddl.split()[0]}'.*not a supported canonical"):
        require_canonical(schema)


def test_contract_on_nested_types():
    nested = T.ArrayType(T.StructType().add("x", T.FloatType()).add("y", T.ArrayType(T.StringType())))
    assert canonical_name(nested) == "List(Struct(x: Float32, y: List(Utf8)))"


ARROW_REJECTED = [
    pa.decimal128(10, 2), pa.duration("s"), pa.time64("us"), pa.binary(), pa.float16(), pa.null(), pa.date64(),
    pa.dictionary(pa.int32(), pa.string()), pa.large_list(pa.int32()), pa.list_(pa.int32(), 2), pa.timestamp("s"),
    pa.map_(pa.string(), pa.int32()), pa.list_(pa.binary()),
]


@pytest.mark.parametrize("dtype", ARROW_REJECTED, ids=str)
def test_arrow_contract_rejects(dtype):
    assert arrow_canonical(dtype) is None


def test_arrow_contract_names():
    assert arrow_canonical(pa.uint64()) == ("UInt64", T.DecimalType(20, 0))
    assert arrow_canonical(pa.timestamp("ms", "Europe/Berlin"))[0] == 'Timestamp(Millisecond, Some("Europe/Berlin"))'
    assert arrow_canonical(pa.list_(pa.struct([("a", pa.large_string())])))[0] == "List(Struct(a: LargeUtf8))"


def test_footers_show_types_that_spark_hides(spark, tmp_path):
    hidden = {"d": pa.array([1], pa.duration("s")), "c": pa.array(["x"]).dictionary_encode()}
    for name, column in hidden.items():
        path = str(tmp_path / f"{name}.parquet")
        pq.write_table(pa.table({"ok": [1], name: column}), path)
        with pytest.raises(UnsupportedDataType, match=f"Field '{name}'"):
            scan(spark, path)
    report = footer_contract(detect_formats(list_files(spark, str(tmp_path)))).where("not canonical").collect()
    assert {r.field for r in report} == {"c", "d"}


def test_unsigned_and_nanosecond_columns(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    table = pa.table(
        {
            "u": pa.array([1, 2**64 - 1], pa.uint64()),
            "n": pa.array([-1, 1500], pa.timestamp("ns")),
            "z": pa.array([-1, None], pa.timestamp("ns", "UTC")),
        }
    )
    pq.write_table(table, path)
    arrow = write_file(table, tmp_path / "t.arrow")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        parquet = scan(spark, path)
        for df in (parquet, scan(spark, arrow)):
            rows = df.select("u", "n", F.unix_micros("z").alias("z")).orderBy("u").collect()
            assert [r.u for r in rows] == [1, 2**64 - 1]
            assert [r.n for r in rows] == [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1, 0, 0, 0, 1)]
            assert [r.z for r in rows] == [-1, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    decimals = str(tmp_path / "d.parquet")
    pq.write_table(pa.table({"u": pa.array([1], pa.decimal128(20, 0))}), decimals)
    with pytest.raises(UnsupportedDataType):
        scan(spark, decimals)


def test_detection(spark, tmp_path):
    pq.write_table(ISLANDS, str(tmp_path / "parquet_without_extension"))
    write_file(ISLANDS, tmp_path / "ipc_without_extension")
    pq.write_table(ISLANDS, str(tmp_path / "wrong.CSV"))
    (tmp_path / "short.bin").write_bytes(b"PAR")
    (tmp_path / "other.dat").write_bytes(b"ARR1....")
    for name in ("a.PQ", "b.feather", "c.ipc", "d.tsv", "e.arrow"):
        (tmp_path / name).write_bytes(b"x")
    found = detect_formats(list_files(spark, str(tmp_path))).collect()
    assert {r.path.rsplit("/", 1)[1]: r.format for r in found} == {
        "parquet_without_extension": "parquet",
        "ipc_without_extension": "arrow_ipc",
        "wrong.CSV": "csv",
        "short.bin": None,
        "other.dat": None,
        "a.PQ": "parquet",
        "b.feather": "arrow_ipc",
        "c.ipc": "arrow_ipc",
        "d.tsv": "csv",
        "e.arrow": "arrow_ipc",
    }
    assert scan(spark, str(tmp_path / "parquet_without_extension")).count() == 4
    assert scan(spark, str(tmp_path / "ipc_without_extension")).count() == 4
    assert scan(spark, str(tmp_path / "wrong.CSV"), "parquet").count() == 4
    with pytest.raises(InvalidFormat):
        scan(spark, str(tmp_path / "short.bin"))
    with pytest.raises(SourceIoError):
        scan(spark, str(tmp_path / "nowhere.parquet"))


def test_corrupt_parquet(spark, tmp_path):
    path = tmp_path / "bad.parquet"
    path.write_bytes(b"PAR1" + bytes(range(60)))
    with pytest.raises(CorruptedBatch):
        scan(spark, str(path))
    ipc = tmp_path / "bad.arrow"
    ipc.write_bytes(b"nonsense nonsense nonsense")
    with pytest.raises(CorruptedBatch):
        scan(spark, str(ipc))


def test_ipc_layouts_split_by_batch(spark, tmp_path):
    table = pa.table({"v": pa.array(range(1000), pa.int64()), "s": [f"row {i}" for i in range(1000)]})
    path = write_file(table, tmp_path / "f.arrow", rows=100)
    df = read_ipc(spark, path, partition_bytes=2000)
    assert df.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(r.v for r in df.collect()) == list(range(1000))
    stream = write_file(table, tmp_path / "s.arrow", "stream", rows=100)
    df = read_ipc(spark, stream, partition_bytes=2000, columns=["s"])
    # A stream has no index: a walk over its message headers finds the batches.
    assert df.columns == ["s"] and sorted(r.s for r in df.collect()) == sorted(table["s"].to_pylist())
    assert df.select(F.spark_partition_id()).distinct().count() > 1
    both = read_ipc(spark, str(tmp_path))
    assert both.count() == 2000


def test_serialize_round_trip_keeps_content(spark, tmp_path):
    df = spark.createDataFrame(ISLANDS.to_pandas(), "id int, island string")
    buffers = serialize(df.coalesce(1))
    [row] = buffers.collect()
    assert row.n == 4 and pa.ipc.open_stream(row.ipc).read_all().num_columns == 2
    back = deserialize(buffers, df.schema)
    assert back.schema == df.schema
    assert content_fingerprint(back).collect() == content_fingerprint(df).collect()
    with pytest.raises(UnsupportedDataType):
        serialize(df.withColumn("b", F.lit(b"x")))
    broken = spark.createDataFrame([(bytearray(row.ipc[: len(row.ipc) // 2]),)], "ipc binary")
    with pytest.raises(Exception, match="CorruptedBatch|Expected|Invalid"):
        deserialize(broken, df.schema).collect()


def test_written_files_are_read_back(spark, tmp_path):
    df = spark.range(100).withColumn("t", F.lit("x")).repartition(3)
    for layout in ("file", "stream"):
        files = write_ipc(df, f"file:{tmp_path}/{layout}", layout)
        assert len(files) == 3 and read_ipc(spark, files).exceptAll(df).count() == 0


def test_file_fingerprints_in_both_ways(spark, tmp_path):
    payload = {"a.bin": b"alpha", "sub/b.bin": b"beta" * 1000, "sub/c d%20é.bin": b"gamma"}
    for name, data in payload.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    expected = {name: hashlib.sha256(data).hexdigest() for name, data in payload.items()}
    for limit in (0, 5, 1 << 20):
        rows = file_fingerprints(spark, str(tmp_path), in_row_bytes=limit).collect()
        assert {r.path.split(str(tmp_path) + "/")[1]: r.fingerprint for r in rows} == expected


def test_directory_fingerprint(spark, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a").write_bytes(b"1")
        (tmp_path / folder / "b").write_bytes(b"2")

    def of(folder):
        root = "file:" + str(tmp_path / folder)
        return directory_fingerprint(spark, root).collect()[0].fingerprint

    same = of("one")
    assert same == of("two")
    (tmp_path / "two" / "a").write_bytes(b"2")
    (tmp_path / "two" / "b").write_bytes(b"1")
    assert of("two") != same


def test_empty_and_hidden_files_count(spark, tmp_path):
    payload = {"a": b"1", "_SUCCESS": b"", ".hidden": b"22", "b c": b"", "sub/.d/e": b"333", "sub/_x/y+%20": b"4", "k=1/f": b"5"}
    root = tmp_path / ".store"
    prints = []
    for n, (name, data) in enumerate(payload.items(), 1):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
        prints.append(directory_fingerprint(spark, str(root)).first().fingerprint)
        assert directory_fingerprint(spark, str(root)).first().file_count == n
    (root / "nothing" / "at all").mkdir(parents=True)
    assert len(set(prints)) == len(payload) and directory_fingerprint(spark, str(root)).first().fingerprint == prints[-1]
    below = lambda path: path.split("/.store/")[1]
    assert {below(r.path): r.length for r in walk_files(spark, str(root)).collect()} == {k: len(v) for k, v in payload.items()}
    for limit in (0, 1, 1 << 20):
        rows = file_fingerprints(spark, [str(root), str(root / "sub")], in_row_bytes=limit).collect()
        assert sorted((below(r.path), r.fingerprint) for r in rows) == sorted((k, hashlib.sha256(v).hexdigest()) for k, v in payload.items())
    assert {r.name for r in register_files(spark, str(root)).collect()} == set(payload)
    [one] = file_fingerprints(spark, str(root / "_SUCCESS")).collect()
    assert (one.length, one.fingerprint) == (0, hashlib.sha256(b"").hexdigest())
    (root / "nothing").joinpath("z").write_bytes(b"")
    [empty] = walk_files(spark, str(root / "nothing")).collect()
    assert empty.length == 0
    with pytest.raises(SourceIoError):
        walk_files(spark, str(root / "absent"))


def test_light_registration(spark, tmp_path):
    path = str(tmp_path / "users.parquet")
    pq.write_table(pa.table({"berth": [4, 8, 2], "vessel": [None, "Kestrel", "Osprey"]}), path)
    [row] = register_files(spark, path).collect()
    assert (row.name, row.format, row.row_count) == ("users.parquet", "parquet", 0)
    assert row.byte_size > 0 and len(row.fingerprint) == 64


def test_equal_base_names_stay_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        pq.write_table(pa.table({"berth": [1]}), str(tmp_path / folder / "part-0.parquet"))
    found = lambda paths, names=None: sorted(r.name for r in register_files(spark, paths, names).collect())
    assert found(str(tmp_path)) == ["a/part-0.parquet", "b/part-0.parquet"]
    a, b = str(tmp_path / "a" / "part-0.parquet"), str(tmp_path / "b")
    assert found([a, b], {a: "harbours", b: "ships"}) == ["harbours", "ships/part-0.parquet"]


def test_version_id(spark):
    expected = hashlib.sha256(b"quay77{}").hexdigest()
    [row] = spark.range(1).select(version_id(F.lit("quay77"), F.lit("{}")).alias("v")).collect()
    assert row.v == expected


def test_content_fingerprint_is_a_multiset_hash(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.hex("id")).alias("h"), F.array("id").alias("a"))
    expected = content_fingerprint(df).collect()
    assert content_fingerprint(df.repartition(11).orderBy(F.desc("id"))).collect() == expected
    assert content_fingerprint(df.union(df.limit(1))).collect() != expected
    changed = df.withColumn("h", F.when(F.col("id") == 7, F.lit("?")).otherwise(F.col("h")))
    assert content_fingerprint(changed).collect() != expected
    assert content_fingerprint(df.withColumnRenamed("h", "g")).collect() != expected


def test_content_fingerprint_tells_nulls_from_text_and_ignores_the_zone(spark):
    nulls = spark.createDataFrame([(None, "a")], "x string, y string")
    empty = spark.createDataFrame([("", "a")], "x string, y string")
    letter = spark.createDataFrame([("N", "a")], "x string, y string")
    prints = {content_fingerprint(df).collect()[0].content_fingerprint for df in (nulls, empty, letter)}
    assert len(prints) == 3
    moments = spark.sql("SELECT timestamp'2024-03-31 01:30:00Z' t, timestamp_ntz'2024-03-31 02:30:00' n")
    seen = set()
    for zone in ("UTC", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        seen.add(content_fingerprint(moments).collect()[0].content_fingerprint)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(seen) == 1


def test_ipc_columns_are_found_by_name(spark, tmp_path):
    for name, columns in (("a", {"id": [1], "x": [10], "y": [20]}), ("b", {"id": [3], "y": [70]})):
        batch = pa.table(columns)
        with pa.OSFile(str(tmp_path / f"{name}.arrow"), "wb") as sink, pa.ipc.new_file(sink, batch.schema) as writer:
            writer.write_table(batch)
    with pytest.raises(Exception, match="'x' found 0 times"):
        read_ipc(spark, str(tmp_path)).collect()
    assert sorted(r.y for r in read_ipc(spark, str(tmp_path), columns=["y"]).collect()) == [20, 70]


def test_buffers_without_a_column_are_refused(spark):
    buffers = serialize(spark.range(3))
    with pytest.raises(Exception, match="'x' found 0 times"):
        deserialize(buffers, T.StructType().add("id", "long").add("x", "long")).collect()


def test_unsigned_integers_survive(spark):
    df = spark.sql("select cast(18446744073709551615 as decimal(20,0)) as u union all select null")
    assert deserialize(serialize(df), df.schema).collect() == df.collect()


def test_write_ipc_keeps_other_files_and_empty_frames(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("mine")
    write_ipc(spark.range(5), str(tmp_path / "out"))
    first = {p.name for p in (tmp_path / "out").iterdir()}
    write_ipc(spark.range(7), str(tmp_path / "out"))
    assert first < {p.name for p in (tmp_path / "out").iterdir()} and (tmp_path / "notes.txt").exists()
    assert read_ipc(spark, str(tmp_path / "out")).count() == 12
    write_ipc(spark.range(0), str(tmp_path / "none"))
    empty = read_ipc(spark, str(tmp_path / "none"))
    assert empty.columns == ["id"] and empty.count() == 0


def test_folder_hash_does_not_depend_on_its_place(spark, tmp_path):
    for place in ("plain", "a+b", "x(1)/deep"):
        (tmp_path / place / "sub").mkdir(parents=True)
        (tmp_path / place / "sub" / "f.txt").write_text("same")
    hashes = {directory_fingerprint(spark, str(tmp_path / p)).first().fingerprint for p in ("plain", "a+b", "x(1)/deep")}
    assert len(hashes) == 1
    one = str(tmp_path / "plain" / "sub" / "f.txt")
    assert directory_fingerprint(spark, one).first().fingerprint == file_fingerprints(spark, one).first().fingerprint


def test_nanoseconds_leave_the_session_alone(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    pq.write_table(pa.table({"t": pa.array([1_500], pa.timestamp("ns"))}), path, version="2.6")
    scan(spark, path).collect()
    assert spark.conf.get("spark.sql.legacy.parquet.nanosAsLong") == "false"


def corrupted_pages(tmp_path):
    """A Parquet file with a sound footer whose data pages are overwritten."""
    path = tmp_path / "broken" / "ferries.parquet"
    path.parent.mkdir()
    pq.write_table(pa.table({"n": list(range(50_000)), "s": [f"ferry {i * 7919}" for i in range(50_000)]}), path)
    data = bytearray(path.read_bytes())
    data[5000:25000] = bytes((i * 31 + 7) % 256 for i in range(20_000))
    path.write_bytes(data)
    return str(path)


def test_verified_ingestion_finds_broken_pages(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "log"))
    source = [IngestionSource("ferries", corrupted_pages(tmp_path))]
    [row] = ingest(spark, registry, source, IngestionOptions(verify=True)).collect()
    assert (row.error_code, row.row_count) == ("CorruptedBatch", None)
    assert "ferries" in row.error_message


def test_broken_row_groups_and_batches_are_named(spark, tmp_path):
    rows = pa.table({"n": list(range(30_000)), "s": [f"pier {i * 7919}" for i in range(30_000)]})
    sound, torn, cut = (str(tmp_path / name) for name in ("sound.parquet", "torn.parquet", "cut.parquet"))
    pq.write_table(rows, sound, row_group_size=10_000)
    data = bytearray(Path(sound).read_bytes())
    chunk = pq.ParquetFile(sound).metadata.row_group(1).column(1)
    low = chunk.dictionary_page_offset or chunk.data_page_offset
    data[low : low + chunk.total_compressed_size] = bytes((k * 31 + 7) % 256 for k in range(chunk.total_compressed_size))
    Path(torn).write_bytes(data)
    Path(cut).write_bytes(data[:-40])
    file, stream = str(tmp_path / "a.arrow"), str(tmp_path / "b.arrows")
    for path, new in ((file, pa.ipc.new_file), (stream, pa.ipc.new_stream)):
        with pa.OSFile(path, "wb") as sink, new(sink, rows.schema) as writer:
            writer.write_table(rows, max_chunksize=7_000)
    Path(stream).write_bytes(Path(stream).read_bytes()[:-60_000])
    formats = [(sound, "parquet"), (torn, "parquet"), (cut, "parquet"), (file, "arrow_ipc"), (stream, "arrow_ipc"), ("x.csv", "csv")]
    files = spark.createDataFrame(formats, "path string, format string")
    found = {}
    for r in check_files(files).collect():
        found.setdefault(r.path, []).append((r.part, r.row_count, r.column, r.error is not None))
    by_part = lambda path: sorted(found[path], key=lambda r: (r[0] is None, r[0]))
    assert by_part(sound) == [(k, 10_000, None, False) for k in range(3)]
    assert by_part(torn) == [(0, 10_000, None, False), (1, None, "s", True), (2, 10_000, None, False)]
    assert by_part(cut) == [(None, None, None, True)]
    assert by_part(file) == [(k, n, None, False) for k, n in enumerate((7000, 7000, 7000, 7000, 2000))]
    assert by_part(stream) == [(0, None, None, True)] and "x.csv" not in found
    assert check_files(files.limit(0)).count() == 0
    with pytest.raises(CorruptedBatch, match="torn.parquet: row group 1, column s"):
        scan(spark, torn, verify=True)
    with pytest.raises(CorruptedBatch, match="cut.parquet: footer"):
        require_sound(spark, files.where(F.col("path") == cut))
    assert scan(spark, sound, verify=True).count() == 30_000


def test_declared_types_reach_profile_and_drift_check(spark, tmp_path):
    types = {"u8": pa.uint8(), "u16": pa.uint16(), "u32": pa.uint32(), "u64": pa.uint64(), "large": pa.large_string()}
    texts = {"large": ["a", "b"]}
    table = pa.table({n: pa.array(texts.get(n, [1, 200]), t) for n, t in types.items()})
    first, second = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    pq.write_table(table, first)
    pq.write_table(table.set_column(0, "u8", pa.array([1, 200], pa.int16())), second)
    expected = {"u8": "UInt8", "u16": "UInt16", "u32": "UInt32", "u64": "UInt64", "large": "LargeUtf8"}
    for profile in (profile_parquet(spark, first), profile_columns(scan(spark, first))):
        assert {r.column: r.data_type for r in profile.collect()} == expected
    registry = Registry(spark, str(tmp_path / "log"))
    sources = [IngestionSource("t", first), IngestionSource("t", second)]
    codes = [r.error_code for r in ingest(spark, registry, sources).orderBy("ord").collect()]
    assert codes == [None, "SchemaMismatch"]


def test_partitioned_and_mixed_folders(spark, tmp_path):
    def put(place):
        (tmp_path / place).mkdir(parents=True)
        pq.write_table(pa.table({"id": [1, 2]}), tmp_path / place / "x.parquet")

    put("hive/p=1")
    put("hive/p=2")
    registry = Registry(spark, str(tmp_path / "log"))
    [row] = ingest(spark, registry, [IngestionSource("h", str(tmp_path / "hive"))]).collect()
    stated = [f["name"] for f in json.loads(row.schema_json)["fields"]]
    df = scan(spark, str(tmp_path / "hive"))
    assert stated == df.columns == ["id", "p"] and row.row_count == df.count() == 4
    put("hive/deep")
    with pytest.raises(SchemaMismatch):
        scan(spark, str(tmp_path / "hive"))


def test_csv_options_and_headers_at_ingestion(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("1;2\n3;x\n")
    both = tmp_path / "both"
    both.mkdir()
    (both / "1.csv").write_text("a,b\n1,x\n")
    (both / "2.csv").write_text("\n a, b \n7,y\n8,z\n")
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    (mixed / "1.csv").write_text("a,b\n1,x\n")
    (mixed / "2.csv").write_text("b,a\nyy,22\n")
    registry = Registry(spark, str(tmp_path / "log"))
    options = CsvOptions(delimiter=";", has_header=False)
    sources = [
        IngestionSource("plain", str(tmp_path / "plain.csv"), csv=options),
        IngestionSource("both", str(both)),
        IngestionSource("mixed", str(mixed)),
    ]
    rows = {r.name: r for r in ingest(spark, registry, sources).collect()}
    kinds = {n: [(f["name"], f["type"]) for f in json.loads(rows[n].schema_json)["fields"]] for n in ("plain", "both")}
    assert kinds == {
        "plain": [("column_1", "long"), ("column_2", "string")],
        "both": [("a", "long"), ("b", "string")],
    }
    assert (rows["plain"].row_count, rows["both"].row_count, rows["mixed"].error_code) == (2, 3, "SchemaMismatch")


def test_ipc_reads_only_the_columns_asked_for(spark, tmp_path):
    table = pa.table({"a": pa.array([1, 2], pa.int64()), "b": ["x", "y"], "c": pa.array([0.5, None])})
    path = write_file(table, tmp_path / "t.arrow")
    assert [tuple(r) for r in read_ipc(spark, path, columns=["c", "a"]).orderBy("a").collect()] == [(0.5, 1), (None, 2)]


def test_quoted_noncharacters_stay(spark):
    mark, other = chr(0xFDD0), chr(0xFDD6)
    lines = spark.createDataFrame([(f'"x{mark}y{mark}{other},z",2',)], "line string")
    [row] = lines.select(split_cells(F.col("line"), ",").alias("cells")).collect()
    assert row.cells == [f"x{mark}y{mark}{other},z", "2"]
