"""Lines packed into batches of bounded size, as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linescan.session import scratch


def line_bytes(value: str = "value") -> Column:
    """Bytes of a line with its newline."""
    return F.octet_length(value) + 1


def pack_batches(lines: DataFrame, keys: list[str], order: list[str], max_bytes: int, value: str = "value") -> DataFrame:
    """``lines`` plus batch_id, from 0 within ``keys``.

    A batch takes lines in order while the bytes before a line are below the next
    multiple of ``max_bytes``, so it passes the limit by one line at most. A key's
    lines may fill many ranges of one range sort; each range sums for itself and
    adds what the ranges before it hold, so a key with most of the lines is not
    one task's work. ``order`` should be unique within a key.
    """
    if not keys:
        raise ValueError("batches need keys: ids are counted within them")
    spark = lines.sparkSession
    path = scratch(spark, "ranges")
    lines.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.parquet(path)
    sizes = ranges.groupBy(*keys, "_part").agg(F.sum(line_bytes(value)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("_before", F.coalesce(F.sum(line_bytes(value)).over(own), F.lit(0)))
    same = [ranges_key.eqNullSafe(F.col(f"s.{k}")) for k, ranges_key in ((k, F.col(f"p.{k}")) for k in [*keys, "_part"])]
    joined = placed.alias("p").join(starts.alias("s"), reduce(Column.__and__, same))
    batch = F.floor((F.col("s._start") + F.col("p._before")) / max_bytes)
    return joined.select(*(F.col(f"p.{c}") for c in lines.columns), batch.alias("batch_id"))
