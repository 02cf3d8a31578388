"""Object catalogs: metadata of files below a root, or of an inventory table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescan.sources.listing import list_under

COLUMNS = ["bucket", "key", "size", "last_modified"]


def list_objects(spark: SparkSession, root: str, bucket: str | None = None, prefixes: list[str] | DataFrame | None = None) -> DataFrame:
    """(bucket, key, size, last_modified) of all files below ``root``; keys are relative to it.

    With ``prefixes``, a list or a table with a column prefix, only what lies under
    one of them is listed, by tasks, each folder once; if nothing does, the catalog is
    empty. No content is read. Names that begin with ``_`` or ``.`` are passed over.
    """
    base = root.split("://", 1)[-1].rstrip("/").removeprefix("file:")
    name = F.lit(bucket if bucket is not None else base.rsplit("/", 1)[-1]).alias("bucket")
    if prefixes is not None:
        given = prefixes if isinstance(prefixes, DataFrame) else spark.createDataFrame([(p,) for p in prefixes], "prefix string")
        return list_under(spark, root, given.select("prefix")).select(name, "key", "size", "last_modified")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    key = F.substring_index(F.col("path"), base + "/", -1)
    return files.select(name, key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def from_inventory(table: DataFrame) -> DataFrame:
    """A catalog from a table with the same columns; rows that lack key, size or last_modified are passed over."""
    return table.select(*COLUMNS).where("key IS NOT NULL AND size IS NOT NULL AND last_modified IS NOT NULL")
