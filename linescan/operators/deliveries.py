"""What became of batches, read off the log that the sink writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linescan.functions.delivery import classify_response, retry_delay_ms

BATCH = ["run", "task", "attempt", "batch"]


def with_class(log: DataFrame) -> DataFrame:
    """``log`` plus class: ok, throttled, fatal or retry."""
    return log.withColumn("class", classify_response(F.col("status")))


def batch_outcomes(log: DataFrame) -> DataFrame:
    """For each batch: tries, the class of the last one, outcome (sent or dropped), lines and bytes."""
    last = F.max_by(F.struct("class", "lines", "plaintext_bytes", "compressed_bytes"), "try").alias("last")
    found = with_class(log).groupBy(*BATCH).agg(F.count(F.lit(1)).alias("tries"), last)
    outcome = F.when(F.col("last.class") == "ok", "sent").otherwise("dropped").alias("outcome")
    return found.select(*BATCH, "tries", "last.*", outcome)


def outcome_totals(log: DataFrame) -> DataFrame:
    """One row: lines and batches sent, lines dropped of those that were tried, bytes sent, tries."""
    sent = F.col("outcome") == "sent"
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    return batch_outcomes(log).agg(
        total("lines", sent).alias("lines_sent"), total("lines", ~sent).alias("lines_dropped"), F.count_if(sent).alias("batches_sent"),
        total("plaintext_bytes", sent).alias("plaintext_bytes_sent"), total("compressed_bytes", sent).alias("compressed_bytes_sent"), F.coalesce(F.sum("tries"), F.lit(0)).alias("tries"),
    )


def retry_delays(log: DataFrame) -> DataFrame:
    """Tries that were followed by another one, plus retry (the how-maniest of its class in a row) and delay_ms, the least wait before the next."""
    order = Window.partitionBy(*BATCH).orderBy("try")
    kind = F.col("class")
    rows = with_class(log).withColumn("more", F.lead("try").over(order).isNotNull())
    # Refusals are counted over the batch, failures from the last refusal on.
    since = rows.withColumn("refused", F.count_if(kind == "throttled").over(order))
    failed = F.count_if(kind == "retry").over(Window.partitionBy(*BATCH, "refused").orderBy("try"))
    counted = since.withColumn("retry", F.when(kind == "throttled", F.col("refused")).otherwise(failed))
    return counted.where("more").withColumn("delay_ms", retry_delay_ms(F.col("retry"), F.col("retry_after"))).drop("more", "refused")


def held_rate(log: DataFrame, rate: float, room: float) -> DataFrame:
    """(run, task, attempt, tries, held): did what a task had sent at each moment fit into its bucket and what had flown in since?"""
    order = Window.partitionBy("run", "task", "attempt").orderBy("batch", "try")
    sent = F.sum("compressed_bytes").over(order)
    elapsed = F.col("began")  # on the task's own clock, which began with the bucket
    rows = log.withColumn("fits", sent <= room + rate * elapsed + F.col("compressed_bytes") + 1)
    return rows.groupBy("run", "task", "attempt").agg(F.count(F.lit(1)).alias("tries"), F.every("fits").alias("held"))
