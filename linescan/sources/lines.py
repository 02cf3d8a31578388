"""Lines of plain, gzip and zstd text, with the object that each came from.

Spark's text source picks the codec by the suffix (.gz, .zst, .zstd), so one
read takes mixed formats. A line ends at ``\\n`` only; a ``\\r`` stays part of
it. Corrupt and missing files fail the job unless told otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _reader(spark: SparkSession, skip_bad: bool):
    reader = spark.read.option("lineSep", "\n")
    # Both keep what was read before the damage.
    return reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True) if skip_bad else reader


def literal_path(path: str) -> str:
    """The path as a pattern that only it matches."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_lines(spark: SparkSession, paths: str | list[str], skip_bad: bool = False) -> DataFrame:
    """(value) of all files below the paths."""
    return _reader(spark, skip_bad).option("recursiveFileLookup", True).text(paths)


def read_hours(spark: SparkSession, root: str, hours: list[tuple[str, str]], hour_name: str = "hour", skip_bad: bool = False) -> DataFrame:
    """(value, dt, hour) of the given hours of a tree ``dt=.../hour=...``; other hours are never opened.

    The hours become literals in a filter on partitions: a range where they are
    contiguous, else a list. dt and hour stay strings.
    """
    lines = _reader(spark, skip_bad).schema(f"value string, dt string, {hour_name} string").text(root)
    return lines.where(_in_hours(F.concat("dt", F.col(hour_name)), hours)).withColumnRenamed(hour_name, "hour")


def _in_hours(key: Column, hours: list[tuple[str, str]]) -> Column:
    from datetime import datetime, timedelta

    keys = sorted({d + h for d, h in hours})
    if not keys:
        return F.lit(False)
    times = [datetime.strptime(k, "%Y%m%d%H") for k in keys]
    if all(b - a == timedelta(hours=1) for a, b in zip(times, times[1:])):
        return key.between(keys[0], keys[-1])
    return key.isin(keys)


def prefix_glob(root: str, prefixes: list[str]) -> str:
    """One pattern for whatever lies below ``root`` under one of the prefixes, which are taken literally."""
    inside = sorted({re.sub(r"([,\[\]{}*?\\])", r"\\\1", p) for p in prefixes})
    return f"{literal_path(root.rstrip('/'))}/{{{','.join(inside)}}}*"


def read_prefixes(spark: SparkSession, root: str, prefixes: list[str], skip_bad: bool = False) -> DataFrame:
    """(value) of the files whose path below ``root`` starts with one of the prefixes; prefixes without files add nothing.

    Only folders under the prefixes are listed. If there is no file at all, Spark's error says so.
    """
    return _reader(spark, skip_bad).option("recursiveFileLookup", True).text(prefix_glob(root, prefixes))


def file_path() -> Column:
    """The path of the file that a row was read from, as it is written."""
    # It is held as a URI, in which a plus sign stands for itself.
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def key_of(root: str) -> Column:
    """The key, relative to ``root``, of the file that a row was read from; a filter on it opens no file in vain."""
    base = root.split("://", 1)[-1].rstrip("/").removeprefix("file:")
    return F.substring_index(file_path(), base + "/", -1)


def with_source(lines: DataFrame, root: str, bucket: str | None = None) -> DataFrame:
    """``lines`` plus bucket, key, size and last_modified of the file of each line."""
    base = root.split("://", 1)[-1].rstrip("/").removeprefix("file:")
    return lines.select(
        *lines.columns,
        F.lit(bucket if bucket is not None else base.rsplit("/", 1)[-1]).alias("bucket"),
        key_of(root).alias("key"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("last_modified"),
    )


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly if it comes in fewer partitions than tasks can run at once.

    A small table in one row group is one task, whatever is done with each row; a
    large one has partitions enough and is left alone. For bare scans: the number of
    partitions is read off the plan, which for a plan with a shuffle may run stages.
    """
    spark = df.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    return df.repartition(tasks) if df._jdf.rdd().getNumPartitions() < tasks else df


def explode_lines(df: DataFrame, text: str, *kept: str) -> DataFrame:
    """(kept columns, line_no from 0, value): the lines of a text column.

    The piece behind a final newline is no line. A null or empty text has none.
    """
    cut = df.select(*kept, F.split(F.col(text), "\n").alias("_pieces"))  # a column, so that it is split once
    n = F.size("_pieces") - F.when(F.element_at("_pieces", -1) == "", 1).otherwise(0)
    return cut.select(*kept, F.posexplode(F.slice("_pieces", F.lit(1), n)).alias("line_no", "value"))
