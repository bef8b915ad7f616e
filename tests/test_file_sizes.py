"""Queries on tables whose size makes other files, row groups and tasks than the given ones do."""

from __future__ import annotations

import datetime
import itertools
import os
import random
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from datumgate.functions.cells import DATE, FLOAT64, INT64, TEXT, TIMESTAMP, cell_mask
from datumgate.model import PARQUET
from datumgate.plans import queries as queries_module
from datumgate.sources.verify import check_files

QUERIES = queries_module.all_queries()


@pytest.fixture
def small_splits(spark):
    """Splits far smaller than the tables' row groups, as those of large files are."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "8k")
    yield
    spark.conf.set(key, before)


def orders(count: int) -> pa.Table:
    ids = range(count)
    return pa.table(
        {
            "o_orderkey": pa.array(ids, pa.int64()),
            "o_custkey": pa.array([i * 7919 % 1000 for i in ids], pa.int64()),
            "o_orderstatus": pa.array(["FOP"[i % 3] for i in ids]),
            "o_totalprice": pa.array([i * 31 % 977 / 4 for i in ids], pa.float64()),
            "o_orderdate": pa.array([datetime.datetime(2020, 1, 1) + datetime.timedelta(i % 500) for i in ids], pa.timestamp("us")),
            "o_orderpriority": pa.array([f"{i % 5}-PRIORITY" for i in ids]),
        }
    )


def test_broken_copies_of_files_that_hold_rows(spark, tmp_path, small_splits):
    pq.write_table(orders(5000), tmp_path / "orders.parquet")
    assert spark.read.parquet(str(tmp_path / "orders.parquet")).rdd.glom().map(len).collect()[0] == 0
    found = {(r.format, r.kind): r[2:] for r in QUERIES["verify_broken_files"](spark, str(tmp_path)).collect()}
    assert found == {
        ("parquet", "whole"): (5000, 0, None, ""),
        ("arrow_ipc", "whole"): (5000, 0, None, ""),
        ("parquet", "pages"): (None, 1, 0, "o_orderpriority"),
        ("parquet", "footer"): (None, 1, -1, ""),
        ("arrow_ipc", "batches"): (None, 1, 0, ""),
    }


def test_folders_get_more_files_as_the_table_grows(spark, tmp_path, monkeypatch):
    count = 5000
    lineitem = pa.table({"l_orderkey": pa.array([i * 7919 % 104_729 for i in range(count)], pa.int64())})
    pq.write_table(lineitem, tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"c_custkey": pa.array([1, 2, 3], pa.int64())}), tmp_path / "customer.parquet")
    written, write_ipc = [], queries_module.write_ipc

    def watched(df, folder):
        written.extend(write_ipc(df, folder))
        return written

    monkeypatch.setattr(queries_module, "write_ipc", watched)
    size = (tmp_path / "lineitem.parquet").stat().st_size
    for file_bytes, files in ((size, 4), (-(-size // 9), 9)):
        written.clear()
        monkeypatch.setattr(queries_module, "FOLDER_FILE_BYTES", file_bytes, raising=False)
        found = {r.name: r.row_count for r in QUERIES["ingest_folders"](spark, str(tmp_path)).collect()}
        assert found == {"lineitem": count, "lineitem_ipc": count, "customer_csv": 3, "absent": None}
        assert len(written) == files


def test_decoding_holds_a_slice_of_a_row_group(spark, tmp_path):
    rows = 3_000_000
    numbers = random.Random(5).randbytes(8 * rows)
    table = pa.table({"n": pa.Array.from_buffers(pa.int64(), rows, [None, pa.py_buffer(numbers)])})
    path = str(tmp_path / "one_group.parquet")
    pq.write_table(table, path, row_group_size=rows, use_dictionary=False)
    assert pq.ParquetFile(path).num_row_groups == 1

    # In a process of its own: the pool knows its largest size only.
    code = (
        "import pyarrow as pa; from datumgate.sources.verify import _checked; "
        f"print(_checked({path!r}, {PARQUET!r}, 0) == [({rows}, None, None)], pa.default_memory_pool().max_memory())"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert said[0] == "True" and int(said[1]) < 8 * rows / 2
    files = spark.createDataFrame([(path, PARQUET)], "path string, format string")
    assert [r.row_count for r in check_files(files).collect()] == [rows]


def test_cell_kinds_without_casts(spark):
    """A cast that fails costs far more than a pattern, so no cell is cast to see what it is."""
    kinds = {}
    for year, month, day in itertools.product((0, 1900, 2000, 2023, 2024), range(14), range(33)):
        try:
            # Python has no year 0, which is a leap year.
            datetime.date(year or 2000, month, day)
            real = True
        except ValueError:
            real = False
        for form in ("{:04d}-{:02d}-{:02d}", "{:04d}-{}-{}"):
            text = form.format(year, month, day)
            kinds[text] = DATE if real else TEXT
            kinds[f"{text} 9:5:59"] = TIMESTAMP if real else TEXT
        kinds[f"{year:04d}-{month:02d}-{day:02d}T23:59:59.123456789+23:59"] = TIMESTAMP if real else TEXT
    for hour, minute, second in itertools.product((0, 9, 19, 23, 24, 30), (0, 59, 60), (0, 59, 60)):
        real = hour < 24 and minute < 60 and second < 60
        for text in (f"2024-02-29 {hour}:{minute}:{second}", f"2024-02-29t{hour:02d}:{minute:02d}:{second:02d}z"):
            kinds[text] = TIMESTAMP if real else TEXT
    for number in (0, 7, 10**18 - 1, 10**18, 2**63 - 1, 2**63, 2**63 + 1, 10**19, 10**25):
        for sign, zeros in itertools.product(("", "+", "-"), ("", "0", "0" * 30)):
            signed = -number if sign == "-" else number
            kinds[f"{sign}{zeros}{number}"] = INT64 if -(2**63) <= signed < 2**63 else FLOAT64
    kinds |= {"1e5": FLOAT64, "123e-5": FLOAT64, "12e-5": FLOAT64, "1234-5": TEXT, "+nan": FLOAT64, "+-1": TEXT, "-": TEXT}
    masks = spark.createDataFrame(list(kinds.items()), "cell string, expected int").withColumn("mask", cell_mask(F.col("cell"), ["NA"]))
    assert masks.where("mask <> expected").collect() == []
    assert "cast(" not in masks._jdf.queryExecution().analyzed().toString().lower()
