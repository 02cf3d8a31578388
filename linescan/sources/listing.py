"""Listing of objects in tasks: every folder once, whatever number of prefixes it holds.

A prefix is a folder and the start of names in it. Prefixes are grouped by folder
and dealt to tasks; a task lists a folder without what lies below it and keeps the
names that begin as some prefix asks. Folders among these are dealt out again and
listed to the bottom, so a day's hours are as many tasks as there are hours. The
driver sees neither prefixes nor objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescan.sources.manifest import file_system

LISTED_SCHEMA = "key string, size long, last_modified timestamp, folder boolean"
#: Rows of one batch.
ROWS = 10_000


def _passed_over(name: str) -> bool:
    """Names that Spark's readers do not see."""
    return name.startswith((".", "_")) and not (name.startswith("_") and "=" in name)


def _batches(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()]
    names = ["key", "size", "last_modified", "folder"]
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def list_under(spark: SparkSession, root: str, prefixes: DataFrame, opened: Callable = file_system) -> DataFrame:
    """(key, size, last_modified) of the objects below ``root`` whose key starts with one of ``prefixes`` (prefix), each once.

    Prefixes without objects, repeated ones and null ones add nothing. Names that
    begin with ``_`` or ``.`` are passed over, as Spark's readers do. ``opened``
    gives the file system of a path and the path in it.
    """

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def found() -> Iterator[tuple]:
            system, base = opened(root)
            base = base.rstrip("/")
            for batch in batches:
                for row in batch.to_pylist():
                    starts = tuple(row["starts"])
                    for info in system.get_file_info(fs.FileSelector(f"{base}/{row['at']}".rstrip("/") or "/", allow_not_found=True)):
                        if info.base_name.startswith(starts) and not _passed_over(info.base_name):
                            key = f"{row['at']}/{info.base_name}".lstrip("/")
                            yield key, info.size if info.is_file else None, info.mtime, not info.is_file

        yield from _batches(found())

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def found() -> Iterator[tuple]:
            system, base = opened(root)
            base = base.rstrip("/")
            for batch in batches:
                for key in batch.column("key").to_pylist():
                    for info in system.get_file_info(fs.FileSelector(f"{base}/{key}", recursive=True, allow_not_found=True)):
                        inside = info.path.removeprefix(f"{base}/{key}/")
                        if info.is_file and not any(map(_passed_over, inside.split("/"))):
                            yield f"{key}/{inside}", info.size, info.mtime, False

        yield from _batches(found())

    cut = F.substring_index("prefix", "/", -1)
    at = F.substring("prefix", F.lit(1), F.greatest(F.length("prefix") - F.length(cut) - 1, F.lit(0)))
    folders = prefixes.where("prefix IS NOT NULL").groupBy(at.alias("at")).agg(F.collect_set(cut).alias("starts"))
    tasks = spark.sparkContext.defaultParallelism
    from linescan.operators.catalog import kept

    # Written, so that what was found in the folders is dealt out without listing them again.
    first = kept(folders.repartition(4 * tasks, "at").mapInArrow(children, LISTED_SCHEMA), "folders")
    deep = first.where("folder").select("key").repartition(4 * tasks, "key").mapInArrow(below, LISTED_SCHEMA)
    # A prefix may lie below another one.
    return first.where("NOT folder").unionByName(deep).dropDuplicates(["key"]).select("key", "size", "last_modified")
