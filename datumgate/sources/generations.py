"""Numbered folders of written tables, of which only finished ones count."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .files import filesystem_of, qualified


def newest(spark: SparkSession, folder: str, upto: int | None = None) -> int:
    """The highest number (up to ``upto``) among the finished subfolders ``<number>`` of ``folder``; -1 where there is none.

    A folder is finished once Spark's committer has put ``_SUCCESS`` into it. The driver lists the one folder.
    """
    numbers = [n for n in subfolders(spark, folder) if upto is None or n <= upto]
    full, _ = qualified(spark, folder)
    filesystem, place = filesystem_of(full.rstrip("/"))
    for number in reversed(numbers):
        if filesystem.get_file_info(f"{place}/{number}/_SUCCESS").is_file:
            return number
    return -1


def subfolders(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the subfolders, in order, finished or not."""
    from pyarrow import fs

    full, there = qualified(spark, folder)
    if not there:
        return []
    filesystem, place = filesystem_of(full.rstrip("/"))
    found = filesystem.get_file_info(fs.FileSelector(place))
    return sorted(int(f.base_name) for f in found if f.type == fs.FileType.Directory and f.base_name.isdigit())
