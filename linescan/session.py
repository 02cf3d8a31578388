"""Session settings that the search relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def builder(name: str = "linescan"):
    """A session builder with UTC, adaptive execution, and compact shuffle defaults."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    )


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    A local session without that setting gets a folder under /tmp; a cluster must have it set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file:///tmp/checkpoints/{context.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/linescan/{label}-{uuid.uuid4().hex}"
