"""The given tables: names, columns, types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns of the given tables with their canonical types.
TABLES = {
    "region": {"r_regionkey": "Int32", "r_name": "Utf8"},
    "nation": {"n_nationkey": "Int32", "n_name": "Utf8", "n_regionkey": "Int32"},
    "customer": {
        "c_custkey": "Int64",
        "c_name": "Utf8",
        "c_nationkey": "Int32",
        "c_acctbal": "Float64",
        "c_mktsegment": "Utf8",
    },
    "supplier": {"s_suppkey": "Int64", "s_name": "Utf8", "s_nationkey": "Int32", "s_acctbal": "Float64"},
    "part": {
        "p_partkey": "Int64",
        "p_name": "Utf8",
        "p_brand": "Utf8",
        "p_type": "Utf8",
        "p_size": "Int32",
        "p_retailprice": "Float64",
    },
    "orders": {
        "o_orderkey": "Int64",
        "o_custkey": "Int64",
        "o_orderstatus": "Utf8",
        "o_totalprice": "Float64",
        "o_orderdate": "Timestamp(Microsecond, None)",
        "o_orderpriority": "Utf8",
    },
    "lineitem": {
        "l_orderkey": "Int64",
        "l_partkey": "Int64",
        "l_suppkey": "Int64",
        "l_linenumber": "Int32",
        "l_quantity": "Float64",
        "l_extendedprice": "Float64",
        "l_discount": "Float64",
        "l_tax": "Float64",
        "l_returnflag": "Utf8",
        "l_linestatus": "Utf8",
        "l_shipdate": "Timestamp(Microsecond, None)",
    },
    "events": {
        "event_id": "Int64",
        "ts": "Timestamp(Microsecond, None)",
        "user_id": "Int64",
        "event_type": "Utf8",
        "value": "Float64",
        "props": "Utf8",
    },
    "documents": {"doc_id": "Int64", "text": "Utf8", "lang": "Utf8", "source": "Utf8", "n_chars": "Int64"},
    "embeddings": {"vec_id": "Int64", "embedding": "List(Float32)", "label": "Int32"},
    "pages": {"page_id": "Int64", "url": "Utf8", "html": "Utf8"},
    "benchmark": {"item_id": "Int64", "text": "Utf8"},
    "labels": {"doc_id": "Int64", "quality": "Int32", "toxic": "Int32"},
    "conversations": {"conv_id": "Int64", "turn": "Int64", "role": "Utf8", "text": "Utf8"},
}

SPARK_TYPES = {
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "Float64": T.DoubleType(),
    "Utf8": T.StringType(),
    "Timestamp(Microsecond, None)": T.TimestampNTZType(),
    "List(Float32)": T.ArrayType(T.FloatType()),
}


def path_of(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(path_of(sf_dir, name))


def schema_json(name: str) -> str:
    return T.StructType([T.StructField(c, SPARK_TYPES[t], True) for c, t in TABLES[name].items()]).json()
