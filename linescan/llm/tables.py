"""Reading the input tables and keeping intermediate tables in the shared folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session, where
    there is one machine, may go without; it gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = f"file:///tmp/checkpoints/{context.applicationId}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/corpus/{label}-{uuid.uuid4().hex}"


_watching: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """A list of the paths of all tables that are kept meanwhile. Those that are left in it at the end are removed.

    For tables that nothing reads any more, once the result made from them is kept itself.
    """
    made: list[str] = []
    _watching.append(made)
    try:
        yield made
    finally:
        _watching.remove(made)
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    This cuts lineage: what follows re-reads files that outlive any executor
    instead of computing ``df`` again. Files stay until the folder is cleared, or
    until a ``passing`` around it ends.
    """
    path = new_path(df.sparkSession, label)
    for made in _watching:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
