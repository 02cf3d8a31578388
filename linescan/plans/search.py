"""The whole search as one plan: hours, pruned files, lines, matches, and a sink."""

from __future__ import annotations

import time
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linescan.functions.hours import hour_grid
from linescan.functions.layout import Bucket, check_buckets
from linescan.functions.matching import check_pattern, matches, matches_any
from linescan.operators import catalog as objects
from linescan.operators import summary
from linescan.session import scratch
from linescan.sources.catalog import list_objects
from linescan.sources.http_lines import delivery_stats, write_http
from linescan.sources.lines import literal_path, read_lines, with_source
from linescan.sources.zstd_lines import write_lines, written_files


def match_lines(lines: DataFrame, pattern: str | None, ignore_case: bool = False) -> DataFrame:
    """The lines in whose ``value`` the pattern is found; all of them without one."""
    if pattern is not None:
        check_pattern(lines.sparkSession, pattern, ignore_case)
    return lines.where(matches(F.col("value"), pattern, ignore_case)) if pattern is not None else lines


def select_objects(
    spark: SparkSession, roots: dict[str, str], buckets: list[Bucket], start: datetime, end: datetime, key_regex: str | None = None, distinct: bool = True, truncate: bool = False,
) -> DataFrame:
    """The catalog of the objects that a search reads: listed under the hours' prefixes, filtered by key."""
    if key_regex is not None:
        check_pattern(spark, key_regex)
    hours = hour_grid(spark, start, end, truncate)
    found = None
    for bucket in check_buckets(buckets):
        grid = objects.prefix_grid(hours, [bucket])
        listed = objects.filter_keys(list_objects(spark, roots[bucket.name], bucket.name, grid), key_regex)
        own = objects.filter_suffixes(objects.select_prefixes(listed, grid, distinct), bucket.patterns)
        found = own if found is None else found.unionByName(own)
    return found


def search(
    spark: SparkSession, roots: dict[str, str], buckets: list[Bucket], start: datetime, end: datetime, key_regex: str | None = None,
    line_regex: str | None = None, ignore_case: bool = False, distinct: bool = True, truncate: bool = False, skip_bad: bool = False,
) -> DataFrame:
    """(value, bucket, key, size, last_modified, prefix, dt, hour) of every matching line.

    ``roots`` says where each bucket lies. Folders under the hours' prefixes are
    listed once, by tasks; the files that were chosen are read, and no others are
    opened. The prefix is looked up for the lines that match, not for those that are read.
    """
    catalog = objects.kept(select_objects(spark, roots, buckets, start, end, key_regex, distinct, truncate))
    return search_catalog(catalog, roots, buckets, start, end, line_regex, ignore_case, distinct, truncate, skip_bad)


def search_catalog(
    catalog: DataFrame, roots: dict[str, str], buckets: list[Bucket], start: datetime, end: datetime, line_regex: str | None = None, ignore_case: bool = False,
    distinct: bool = True, truncate: bool = False, skip_bad: bool = False, watched: Observation | None = None,
) -> DataFrame:
    """The same over the objects of a catalog that was kept, as of ``select_objects``; ``watched`` gets the number and bytes of the lines read.

    The driver holds the paths of the chosen files, as Spark's own index of files does.
    """
    spark = catalog.sparkSession
    objects.require_objects(catalog)
    hours = hour_grid(spark, start, end, truncate)
    read = None
    for bucket in check_buckets(buckets):
        root = roots[bucket.name].rstrip("/")
        keys = [r.key for r in catalog.where(F.col("bucket") == bucket.name).select("key").distinct().collect()]
        if keys:
            lines = read_lines(spark, [literal_path(f"{root}/{k}") for k in sorted(keys)], skip_bad)
            lines = with_source(lines, root, bucket.name)
            read = lines if read is None else read.unionByName(lines)
    if watched is not None:
        read = read.observe(watched, F.count(F.lit(1)).alias("lines_read"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes_read"))
    grid = objects.prefix_grid(hours, buckets)
    sizes = sorted((r[0] for r in grid.select(F.length("prefix")).distinct().collect()), reverse=True)  # a layout has few
    tagged = _tagged(match_lines(read, line_regex, ignore_case), grid, sizes, distinct)
    behind = F.substring("key", F.length("prefix") + 1, F.length("key"))
    wanted = reduce(Column.__or__, ((F.col("bucket") == b.name) & matches_any(behind, b.patterns) for b in buckets))
    return tagged.where(wanted).select("value", "bucket", "key", "size", "last_modified", "prefix", "dt", "hour")


def _tagged(lines: DataFrame, grid: DataFrame, sizes: list[int], distinct: bool) -> DataFrame:
    """``lines`` plus prefix, dt and hour: once for each prefix of the key, or once, for the longest one."""
    if distinct:  # a layout without hours has one prefix for many of them; the first one counts
        grid = grid.groupBy("bucket", "prefix").agg(F.min(F.struct("dt", "hour")).alias("t")).select("bucket", "prefix", "t.*")
    if not distinct or len(sizes) == 1:
        return objects.select_prefixes(lines, grid)
    grid = grid.select("bucket", F.col("prefix").alias("p"), F.struct("prefix", "dt", "hour").alias("hit"))
    hits = []
    for n in sizes:
        own = grid.where(F.length("p") == n).select("bucket", "p", F.col("hit").alias(f"hit{n}"))
        lines = lines.withColumn("p", F.substring("key", 1, n)).join(own, ["bucket", "p"], "left").drop("p")
        hits.append(F.col(f"hit{n}"))
    found = lines.withColumn("hit", F.coalesce(*hits)).where("hit IS NOT NULL")
    return found.select("*", "hit.*")


def search_to_files(spark: SparkSession, directory: str, level: int = 3, **query) -> DataFrame:
    """Run a search, write zstd files by prefix, and return the run's summary.

    Objects are listed once and the text is read once: what is searched is the kept
    catalog, what is read is counted as it passes and what is written by the writer,
    so neither objects that come meanwhile nor other files change a figure.
    """
    began = time.monotonic()
    stats = scratch(spark, "written")
    chosen = {k: query.pop(k) for k in ("key_regex",) if k in query}
    where = {k: query[k] for k in ("roots", "buckets", "start", "end", "distinct", "truncate") if k in query}
    catalog = objects.kept(select_objects(spark, **where, **chosen))
    read = Observation("read")
    write_lines(search_catalog(catalog, **query, watched=read), directory, level, stats_path=stats)
    written = written_files(spark, stats)
    packed = summary.output_of_run(written).first()
    seconds = time.monotonic() - began
    run = summary.run_summary(catalog, summary.written_by_prefix(written), query.get("line_regex"), directory, packed.compressed_bytes, seconds)
    return run.select("*", *(F.lit(read.get[c]).cast("long").alias(c) for c in ("lines_read", "bytes_read")))


def search_to_http(spark: SparkSession, url: str, stats_path: str, options: dict | None = None, **query) -> DataFrame:
    """Run a search, post the lines, and return the delivery counts."""
    write_http(search(spark, **query), url, statsPath=stats_path, **(options or {}))
    return delivery_stats(spark, stats_path)
