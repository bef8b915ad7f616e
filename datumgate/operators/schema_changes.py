"""Schema differences of many version pairs as rows."""

from __future__ import annotations

import json
from functools import lru_cache
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.columns import ref
from ..functions.schema_diff import Difference, differences

#: The change of a pair one of whose texts states no schema.
UNREADABLE = "unreadable"
CHANGES = T.StructType([T.StructField(n, T.StringType()) for n in Difference._fields])


@lru_cache(maxsize=1024)
def json_differences(before: str | None, after: str | None) -> tuple[Difference, ...]:
    """Differences of two schemas in JSON; null is the schema without fields."""
    try:
        old, new = (T.StructType.fromJson(json.loads(s)) if s is not None else T.StructType() for s in (before, after))
    except (ValueError, KeyError, TypeError, AttributeError):
        return (Difference(None, UNREADABLE, None, None),)
    return tuple(differences(old, new))


def schema_differences(pairs: DataFrame, before: str = "parent_schema_json", after: str = "schema_json") -> DataFrame:
    """A row per difference of each pair: its other columns, then ``path``, ``change``, ``before``, ``after``.

    Pairs without a difference have no row. Tasks compare; nothing is shuffled, and equal pairs of a task are compared once.
    """
    kept = [f for f in pairs.schema.fields if f.name not in (before, after)]
    taken = {n.lower() for n in CHANGES.names} & {f.name.lower() for f in kept}
    if taken:
        raise ValueError(f"columns called as those of the result: {sorted(taken)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            found = [(k, d) for k, (old, new) in enumerate(texts) for d in json_differences(old, new)]
            rows = pa.array([k for k, _ in found], pa.int64())
            carried = [batch.column(i + 2).take(rows) for i in range(len(kept))]
            changes = [pa.array([d[i] for _, d in found], pa.string()) for i in range(len(CHANGES))]
            yield pa.RecordBatch.from_arrays([*carried, *changes], names=[f.name for f in kept] + CHANGES.names)

    asked = pairs.select(ref(before), ref(after), *[ref(f.name) for f in kept])
    return asked.mapInArrow(run, T.StructType(kept + CHANGES.fields))
