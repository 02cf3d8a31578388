"""Choosing and measuring objects of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linescan.functions.layout import Bucket, check_buckets
from linescan.functions.matching import matches, matches_any
from linescan.session import scratch


def kept(catalog: DataFrame, label: str = "catalog") -> DataFrame:
    """The catalog, written once to the shared folder and read from there: later objects change nothing in it."""
    spark, path = catalog.sparkSession, scratch(catalog.sparkSession, label)
    catalog.write.parquet(path)
    return spark.read.schema(catalog.schema).parquet(path)


def prefix_grid(hours: DataFrame, buckets: list[Bucket]) -> DataFrame:
    """(bucket, prefix, dt, hour): every bucket at every hour of ``hours`` (dt, hour)."""
    each = [F.struct(F.lit(b.name).alias("bucket"), b.prefix(F.col("dt"), F.col("hour")).alias("prefix")) for b in check_buckets(buckets)]
    return hours.select(F.explode(F.array(*each)).alias("g"), "dt", "hour").select("g.bucket", "g.prefix", "dt", "hour")


def select_prefixes(catalog: DataFrame, grid: DataFrame, distinct: bool = False, boundary: bool = False) -> DataFrame:
    """Objects whose key starts with a prefix of their bucket, tagged with the prefix, dt and hour.

    An object appears once for each prefix that it starts with, or once at all, under
    the longest, if ``distinct``. ``boundary`` asks that the key ends or goes on with ``/`` behind
    the prefix. The test is an equality of key starts and prefixes, a hash join on
    either side's own scale: prefixes of a layout have few lengths, and a key is
    cut at those lengths only.
    """
    # A number for each length, at most as many as a key has characters.
    sizes = sorted(r[0] for r in grid.where("prefix IS NOT NULL").select(F.length("prefix")).distinct().collect())
    cuts = F.filter(F.array(*(F.lit(n) for n in sizes)).cast("array<int>"), lambda n: n <= F.length("key"))
    starts = F.transform(cuts, lambda n: F.substring(F.col("key"), F.lit(1), n))
    tagged = catalog.withColumn("prefix", F.explode(starts)).join(grid, ["bucket", "prefix"])
    if boundary:
        behind = F.substring("key", F.length("prefix") + 1, F.lit(1))
        tagged = tagged.where((behind == "") | (behind == "/") | F.col("prefix").endswith("/"))
    if not distinct:
        return tagged
    order = F.struct(-F.length("prefix"), *(F.col(c) for c in grid.columns if c not in ("bucket", "prefix")))
    return tagged.groupBy("bucket", "key").agg(F.min_by(F.struct(*tagged.columns), order).alias("t")).select("t.*")


def filter_keys(catalog: DataFrame, pattern: str | None) -> DataFrame:
    """Objects in whose whole key the pattern is found."""
    return catalog.where(matches(F.col("key"), pattern))


def filter_suffixes(tagged: DataFrame, patterns: list[str]) -> DataFrame:
    """Objects of which the key behind the prefix matches one of the patterns; without patterns, all."""
    return tagged.where(matches_any(F.substring("key", F.length("prefix") + 1, F.length("key")), patterns))


def totals(catalog: DataFrame) -> DataFrame:
    """One row: objects, compressed bytes, and MB of 10^6 bytes."""
    size = F.coalesce(F.sum("size"), F.lit(0))
    return catalog.agg(F.count("*").alias("objects"), size.alias("bytes"), (size / 1_000_000).alias("mb"))


def by_prefix(tagged: DataFrame, pattern: str | None) -> DataFrame:
    """For each bucket and prefix, objects listed and objects that the key pattern keeps."""
    return tagged.groupBy("bucket", "prefix").agg(F.count("*").alias("listed"), F.count_if(matches(F.col("key"), pattern)).alias("kept"))


def order_by_size(catalog: DataFrame) -> DataFrame:
    """Small objects first; ties by bucket and key."""
    return catalog.orderBy("size", "bucket", "key")


def require_objects(catalog: DataFrame) -> DataFrame:
    """The catalog; an empty one is an error."""
    if catalog.isEmpty():
        raise ValueError("No objects found to search")
    return catalog
