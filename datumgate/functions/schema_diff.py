"""What differs between two schemas, field by field, nested fields included."""

from __future__ import annotations

from typing import Iterator, NamedTuple

from pyspark.sql import types as T

from .types import STORED_TYPE

ADDED, REMOVED, MOVED = "added", "removed", "moved"
WIDENED, NARROWED, RETYPED, NULLABILITY = "widened", "narrowed", "retyped", "nullability"
# Types of one line hold all values of those before them.
_WIDER = (
    (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    (T.ByteType, T.ShortType, T.IntegerType, T.DoubleType),
    (T.FloatType, T.DoubleType),
)


class Difference(NamedTuple):
    path: str
    change: str
    before: str | None
    after: str | None


def _holds_all(wide: T.DataType, narrow: T.DataType) -> bool:
    if isinstance(wide, T.DecimalType) and isinstance(narrow, T.DecimalType):
        return wide.scale >= narrow.scale and wide.precision - wide.scale >= narrow.precision - narrow.scale
    lines = [line for line in _WIDER if type(wide) in line and type(narrow) in line]
    return any(line.index(type(wide)) >= line.index(type(narrow)) for line in lines)


def _shown(field: T.StructField) -> str:
    """The declared type where Spark reads another one, else Spark's name."""
    return field.metadata.get(STORED_TYPE) or field.dataType.simpleString()


def _type_changes(path: str, before: T.DataType, after: T.DataType, shown: tuple[str, str]) -> Iterator[Difference]:
    if isinstance(before, T.StructType) and isinstance(after, T.StructType):
        yield from differences(before, after, f"{path}.")
    elif isinstance(before, T.ArrayType) and isinstance(after, T.ArrayType):
        if before.containsNull != after.containsNull:
            yield Difference(f"{path}[]", NULLABILITY, _nullable(before.containsNull), _nullable(after.containsNull))
        inner = before.elementType, after.elementType
        yield from _type_changes(f"{path}[]", *inner, (inner[0].simpleString(), inner[1].simpleString()))
    elif before != after:
        change = WIDENED if _holds_all(after, before) else NARROWED if _holds_all(before, after) else RETYPED
        yield Difference(path, change, *shown)
    elif shown[0] != shown[1]:
        yield Difference(path, RETYPED, *shown)


def _nullable(value: bool) -> str:
    return "nullable" if value else "not null"


def differences(before: T.StructType, after: T.StructType, prefix: str = "") -> Iterator[Difference]:
    """Differences in the order of ``after``, removed fields last.

    Fields are matched by exact name; a nested field is ``a.b``, an element ``a[]``. A field is moved
    when its place among the fields that both schemas have is another one, so an added or removed
    neighbour moves none; the places count from 0.
    """
    old, new = {f.name: f for f in before}, {f.name: f for f in after}
    old_places = {name: k for k, name in enumerate(n for n in old if n in new)}
    new_places = {name: k for k, name in enumerate(n for n in new if n in old)}
    for name, field in new.items():
        path = prefix + name
        if name not in old:
            yield Difference(path, ADDED, None, _shown(field))
            continue
        was = old[name]
        yield from _type_changes(path, was.dataType, field.dataType, (_shown(was), _shown(field)))
        if was.nullable != field.nullable:
            yield Difference(path, NULLABILITY, _nullable(was.nullable), _nullable(field.nullable))
        if old_places[name] != new_places[name]:
            yield Difference(path, MOVED, str(old_places[name]), str(new_places[name]))
    for name, field in old.items():
        if name not in new:
            yield Difference(prefix + name, REMOVED, _shown(field), None)
