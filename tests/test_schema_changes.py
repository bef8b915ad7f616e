"""Schema differences: kinds, nesting, texts that state no schema, and ingestion that names the field."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from datumgate.functions.schema_diff import differences
from datumgate.functions.types import STORED_TYPE
from datumgate.model import IngestionSource
from datumgate.operators.ingest import ingest
from datumgate.operators.registry import Registry
from datumgate.operators.schema_changes import schema_differences


@pytest.mark.parametrize(
    ("before", "after", "expected"),
    [
        ("a int", "a int", []),
        ("a int", "a double", [("a", "widened", "int", "double")]),
        ("a double", "a int", [("a", "narrowed", "double", "int")]),
        ("a bigint", "a double", [("a", "retyped", "bigint", "double")]),
        ("a decimal(5,2)", "a decimal(9,4)", [("a", "widened", "decimal(5,2)", "decimal(9,4)")]),
        ("a decimal(5,2)", "a decimal(5,4)", [("a", "retyped", "decimal(5,2)", "decimal(5,4)")]),
        ("a struct<x:int>", "a string", [("a", "retyped", "struct<x:int>", "string")]),
        ("a array<struct<x:int,y:int>>", "a array<struct<y:int>>", [("a[].x", "removed", "int", None)]),
        ("a int, b int", "c int, b int, a int", [("c", "added", None, "int"), ("b", "moved", "1", "0"), ("a", "moved", "0", "1")]),
        ("a int, b int", "b int", [("a", "removed", "int", None)]),
        ("a int", "A int", [("A", "added", None, "int"), ("a", "removed", "int", None)]),
    ],
)
def test_differences(spark, before, after, expected):
    old, new = T.StructType.fromDDL(before), T.StructType.fromDDL(after)
    assert [tuple(d) for d in differences(old, new)] == expected


def test_nullability_and_declared_types():
    declared = T.StructField("u", T.IntegerType(), True, {STORED_TYPE: "UInt16"})
    old = T.StructType([declared, T.StructField("l", T.ArrayType(T.IntegerType(), True), True)])
    new = T.StructType([T.StructField("u", T.IntegerType(), False), T.StructField("l", T.ArrayType(T.IntegerType(), False), True)])
    assert [tuple(d) for d in differences(old, new)] == [
        ("u", "retyped", "UInt16", "int"),
        ("u", "nullability", "nullable", "not null"),
        ("l[]", "nullability", "nullable", "not null"),
    ]


def test_rows_of_pairs(spark):
    a, b = (T.StructType.fromDDL(d).json() for d in ("x int", "x bigint, y string"))
    rows = [(1, a, b), (2, a, a), (3, None, a), (4, a, "no schema"), (5, "[]", a), (1, a, b)]
    pairs = spark.createDataFrame(rows, "n int, parent_schema_json string, schema_json string")
    found = sorted((r.n, r.path or "", r.change) for r in schema_differences(pairs).collect())
    twice = [(1, "x", "widened"), (1, "y", "added")]
    assert found == sorted(twice * 2 + [(3, "x", "added"), (4, "", "unreadable"), (5, "", "unreadable")])
    assert schema_differences(pairs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="path"):
        schema_differences(pairs.withColumnRenamed("n", "Path"))


def test_strict_ingestion_names_the_fields(spark, tmp_path):
    spark.range(3).selectExpr("id", "1 as n").write.parquet(str(tmp_path / "a"))
    spark.range(3).selectExpr("cast(id as int) as id", "'t' as note").write.parquet(str(tmp_path / "b"))
    registry = Registry(spark, str(tmp_path / "registry"))
    ingest(spark, registry, [IngestionSource("t", str(tmp_path / "a"))]).collect()
    (row,) = ingest(spark, registry, [IngestionSource("t", str(tmp_path / "b"))]).collect()
    assert row.error_code == "SchemaMismatch"
    assert row.error_message.endswith("version: id narrowed bigint to int; note added string; n removed int")
