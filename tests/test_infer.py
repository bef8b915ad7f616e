from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datumgate.errors import InvalidFormat
from datumgate.functions.cells import cell_mask, split_cells, trim, typed_cell
from datumgate.model import NULL_TOKENS, CsvOptions
from datumgate.operators.infer import column_masks, infer_masks, infer_schema, load_delimited
from datumgate.sources.delimited import first_lines, read_lines
from datumgate.sources.scan import scan


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


PRIMITIVES = (
    "berth,vessel,loaded,draught,moored,built\n"
    "41,Kestrel,false,7.25,2019-08-03T05:06:07Z,1978-02-28\n"
    "42,,true,11.0,2019-08-04 23:59:59,2003-12-31\n"
    "57,Osprey,true,,2020-02-29T00:00:00Z,1999-01-01"
)


def test_primitive_types(spark, tmp_path):
    schema = infer_schema(spark, write(tmp_path, "a.csv", PRIMITIVES))
    assert schema.simpleString() == (
        "struct<berth:bigint,vessel:string,loaded:boolean,draught:double,moored:timestamp_ntz,built:date>"
    )
    assert all(f.nullable for f in schema)


def test_promotion_and_fallback(spark, tmp_path):
    path = write(tmp_path, "a.csv", "depth,flag\n12,false\n-3,maybe\n4.5,true")
    assert infer_schema(spark, path).simpleString() == "struct<depth:double,flag:string>"


@pytest.mark.parametrize("text", ["", "\n \n\t\n"])
def test_empty_input_fails(spark, tmp_path, text):
    with pytest.raises(InvalidFormat):
        infer_schema(spark, write(tmp_path, "a.csv", text))


def test_header_only_columns_are_strings(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a,b\n")
    assert infer_schema(spark, path).simpleString() == "struct<a:string,b:string>"
    assert load_delimited(spark, path).count() == 0


CELLS = {
    0: ["", "null", "NULL", "None", "NA", "N/A", "nan", "NaN"],
    1: ["true", "FALSE", "True"],
    2: ["0", "-7", "+7", "9223372036854775807", "-9223372036854775808", "007"],
    4: ["9223372036854775808", "1.5", "5.", ".5", "-.5e3", "1e5", "1E-5", "inf", "-Infinity", "+inf", "Nan", "-nan", "123e-5"],
    8: ["2026-01-15", "2024-02-29", "2026-1-5"],
    16: [
        "2026-01-15T08:30:00Z",
        "2026-01-15t08:30:00z",
        "2026-01-15T08:30:00.123+02:00",
        "2026-01-15T08:30:00-23:30",
        "2026-01-15 08:30:00",
        "2026-01-15T08:30:00",
    ],
    32: [
        "Null", "none", "n/a", "1.0d", "1f", "0x10", "1_000", ".", "+", "-", "1e", "e5", "1 2", "2023-02-29", "2026-13-01",
        "26-01-15", "2026-01-15T08:30", "2026-03-01 10:00:00.5", "2026-01-15T25:00:00Z", "2026-01-15T08:30:00+0200", "abc",
        "infinite", "truee", "é",
    ],
}


def test_cell_kinds(spark):
    rows = [(mask, cell) for mask, cells in CELLS.items() for cell in cells]
    df = spark.createDataFrame(rows, "expected int, cell string")
    wrong = df.withColumn("got", cell_mask(F.col("cell"), NULL_TOKENS)).where("got != expected").collect()
    assert wrong == []


def test_null_tokens_of_the_caller(spark):
    df = spark.createDataFrame([("-999",), ("NA",), ("2024-01-01",), ("",)], "cell string")
    masks = df.select(cell_mask(F.col("cell"), ("-999", "2024-01-01", "")).alias("m")).collect()
    assert [r.m for r in masks] == [0, 32, 0, 0]
    assert [r.m for r in df.select(cell_mask(F.col("cell"), ()).alias("m")).collect()] == [2, 32, 8, 32]


#: Lines and their trimmed cells, written with commas as delimiters.
SPLITS = {
    "a,b,c": ["a", "b", "c"],
    "": [""],
    ",": ["", ""],
    ",,": ["", "", ""],
    "one": ["one"],
    "  ": [""],
    ' a , "b, c" ,d': ["a", "b, c", "d"],
    '"a""b",c': ["ab", "c"],
    '"open, a': ["open, a"],
    'x"y,z"w,q': ["xy,zw", "q"],
    '""': [""],
    '"",""': ["", ""],
    'é"é,é",é': ["éé,é", "é"],
    '"a" , b': ["a", "b"],
    'a, "b " ,c\r': ["a", "b", "c"],
    '" lead",trail ': ["lead", "trail"],
}


@pytest.mark.parametrize("delimiter", [",", "|", "\t", ";"])
def test_split_cells(spark, delimiter):
    expected = {line.replace(",", delimiter): [c.replace(",", delimiter) for c in cells] for line, cells in SPLITS.items()}
    df = spark.createDataFrame([(line,) for line in expected], "line string")
    got = df.select("line", F.transform(split_cells(F.col("line"), delimiter), trim).alias("cells")).collect()
    assert {r.line: r.cells for r in got} == expected


def test_short_and_long_rows_and_no_header(spark, tmp_path):
    path = write(tmp_path, "a.csv", "1,2\n3\n4,5,surplus\n")
    options = CsvOptions(has_header=False)
    assert infer_schema(spark, path, options).simpleString() == "struct<column_1:bigint,column_2:bigint>"
    rows = [tuple(r) for r in load_delimited(spark, path, options).collect()]
    assert sorted(rows, key=str) == [(1, 2), (3, None), (4, 5)]


def test_tsv_keeps_empty_edge_cells(spark, tmp_path):
    path = write(tmp_path, "a.TSV", "a\tb\tc\n\t2\tx\n1\t\t\n")
    rows = sorted((tuple(r) for r in scan(spark, path).collect()), key=str)
    assert rows == [(1, None, None), (None, 2, "x")]


def test_folder_of_tsv_files(spark, tmp_path):
    for i in range(3):
        write(tmp_path, f"{i}.tsv", f"a\tb\n{i}\t{i}.5\n")
    df = scan(spark, str(tmp_path))
    assert df.schema.simpleString() == "struct<a:bigint,b:double>"
    assert sorted(map(tuple, df.collect())) == [(0, 0.5), (1, 1.5), (2, 2.5)]


def test_header_is_the_first_non_blank_line(spark, tmp_path):
    path = write(tmp_path, "a.csv", "\n  \n a , b\n1,2\na,b\n")
    assert [r.line for r in read_lines(spark, path, skip_header=True).collect()] == ["1,2", "a,b"]
    assert infer_schema(spark, path).names == ["a", "b"]


def test_lines_survive_odd_characters(spark, tmp_path):
    odd = ["\\,x", "\x00,y", "#c,1", '"q', "'s,2", "  lead,3", "\x01,\x02"]
    path = write(tmp_path, "a.csv", "h,i\n" + "\n".join(odd) + "\n")
    assert sorted(r.line for r in read_lines(spark, path, skip_header=True).collect()) == sorted(odd)


def test_sample_counts_the_header(spark, tmp_path):
    path = write(tmp_path, "a.csv", "v\n1\n\n2\n3.5\nx\n")
    for sample, expected in ((1, "string"), (2, "bigint"), (3, "bigint"), (4, "double"), (5, "string"), (None, "string")):
        masks = infer_masks(spark, path, CsvOptions(max_sample_rows=sample)).collect()
        assert [m.data_type for m in masks] == [expected], sample


def test_sample_reads_on_when_the_first_block_is_short(spark, tmp_path):
    path = write(tmp_path, "a.csv", "v\n" + "\n".join(str(i) for i in range(400)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = [r.line for r in first_lines(spark, path, 300, skip_header=True).collect()]
        few = [r.line for r in first_lines(spark, path, 5, skip_header=True).collect()]
        whole = read_lines(spark, path, skip_header=True).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(int, got)) == list(range(300))
    assert sorted(map(int, few)) == list(range(5))
    assert whole == 400


def test_partitioning_does_not_change_the_types(spark):
    lines = spark.range(5000).select(
        F.concat_ws(",", "id", F.col("id") / 4, F.when(F.col("id") == 4321, "x").otherwise("1")).alias("line")
    )
    expected = column_masks(lines.coalesce(1), ["a", "b", "c"]).collect()
    assert column_masks(lines.repartition(17), ["a", "b", "c"]).collect() == expected
    assert [r.data_type for r in expected] == ["bigint", "double", "string"]


def test_many_columns(spark):
    names = [f"c{i}" for i in range(450)]
    lines = spark.createDataFrame([(",".join("1" if i % 2 else "x" for i in range(n)),) for n in (450, 300, 460)], "line string")
    rows = column_masks(lines, names).orderBy("position").collect()
    assert [r.data_type for r in rows] == ["bigint" if i % 2 else "string" for i in range(450)]


def test_typed_cells(spark):
    cases = [
        ("2026-02-20T14:15:00+02:00", "timestamp_ntz", dt.datetime(2026, 2, 20, 12, 15)),
        ("2026-02-20T14:15:00.25-23:30", "timestamp_ntz", dt.datetime(2026, 2, 21, 13, 45, 0, 250000)),
        ("2026-02-20 14:15:00", "timestamp_ntz", dt.datetime(2026, 2, 20, 14, 15)),
        ("2026-02-20", "timestamp_ntz", dt.datetime(2026, 2, 20)),
        ("2026-2-3", "date", dt.date(2026, 2, 3)),
        ("TRUE", "boolean", True),
        ("+12", "bigint", 12),
        ("1e3", "double", 1000.0),
        ("-Infinity", "double", -math.inf),
        ("1.0d", "double", None),
        ("NA", "string", None),
        (" x", "string", " x"),
    ]
    kinds = {"timestamp_ntz": T.TimestampNTZType(), "date": T.DateType(), "boolean": T.BooleanType(),
             "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for text, kind, expected in cases:
                df = spark.createDataFrame([(text,)], "c string")
                [row] = df.select(typed_cell("c", kinds[kind], NULL_TOKENS).alias("v")).collect()
                assert row.v == expected, (text, zone)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
