"""Measures of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linescan.operators.batches import line_bytes
from linescan.operators.catalog import totals
from linescan.sources.catalog import list_objects


def match_count(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count("*").alias("matches"))


def output_by_prefix(matched: DataFrame, prefix: str = "prefix") -> DataFrame:
    """For each prefix, lines and plaintext bytes with newlines."""
    return matched.groupBy(prefix).agg(F.count("*").alias("lines"), F.sum(line_bytes()).alias("plaintext_bytes"))


def output_files(spark: SparkSession, directory: str) -> DataFrame:
    """One row: files below an output directory and their bytes, whoever wrote them."""
    return totals(list_objects(spark, directory)).select(F.col("objects").alias("files"), F.col("bytes").alias("compressed_bytes"))


def output_of_run(written: DataFrame) -> DataFrame:
    """The same of the files that one run wrote, from the rows of ``written_files``."""
    return written.agg(F.count("*").alias("files"), F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias("compressed_bytes"))


def written_by_prefix(written: DataFrame) -> DataFrame:
    """For each prefix of a run's files, lines, plaintext and compressed bytes."""
    sums = (F.sum(c).alias(c) for c in ("lines", "plaintext_bytes", "compressed_bytes"))
    return written.groupBy("prefix").agg(*sums)


def compression_ratio(plain: Column, compressed: Column) -> Column:
    """plain / compressed, 0 where nothing was written."""
    return F.when(compressed > 0, plain / compressed).otherwise(F.lit(0.0))


def throughput(size: Column, seconds: Column) -> Column:
    """MB of 10^6 bytes a second, 0 where no time passed."""
    return F.when(seconds > 0, size / 1_000_000 / seconds).otherwise(F.lit(0.0))


def run_summary(
    catalog: DataFrame, by_prefix: DataFrame, pattern: str | None, destination: str, compressed_bytes: int | None = None, seconds: float | None = None
) -> DataFrame:
    """One record of a run: objects searched, matches, sizes, ratio, rates, pattern and destination."""
    searched = catalog.agg(F.count("*").alias("files_searched"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_searched"))
    found = by_prefix.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("matches"), F.coalesce(F.sum("plaintext_bytes"), F.lit(0)).alias("plaintext_bytes"))
    packed = F.lit(compressed_bytes).cast("long")
    took = F.lit(seconds).cast("double")
    return searched.crossJoin(found).select(  # one row each
        "files_searched", "bytes_searched", "matches", "plaintext_bytes",
        packed.alias("compressed_bytes"), compression_ratio(F.col("plaintext_bytes"), packed).alias("ratio"),
        throughput(F.col("plaintext_bytes"), took).alias("plaintext_mb_s"), throughput(packed, took).alias("compressed_mb_s"),
        F.lit(pattern if pattern is not None else "(all lines)").alias("pattern"), F.lit(destination).alias("destination"),
    )
