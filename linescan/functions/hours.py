"""Hours of a time range and their text forms, in UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hour_steps(start: Column, end: Column, truncate: bool = False) -> Column:
    """Array of instants from ``start`` on, an hour apart, while they are not after ``end``.

    The steps begin at ``start`` itself, so a range from 10:30 to 12:15 has 10:30
    and 11:30; ``truncate`` begins at the full hour instead. A start after the
    end is an error when the query runs. Nulls give null.
    """
    first = F.date_trunc("hour", start).cast("timestamp_ntz") if truncate else start
    steps = F.sequence(first, end, F.expr("INTERVAL 1 HOUR"))
    problem = F.concat(F.lit("start "), start.cast("string"), F.lit(" is after end "), end.cast("string"))
    return F.when(start > end, F.raise_error(problem)).otherwise(F.when(first <= end, steps))


def hour_key(ts: Column) -> tuple[Column, Column]:
    """(yyyyMMdd, HH) of an instant, both strings; set the session's time zone to UTC."""
    return F.date_format(ts, "yyyyMMdd"), F.date_format(ts, "HH")


def with_hour_key(df: DataFrame, ts: str) -> DataFrame:
    dt, hour = hour_key(F.col(ts))
    return df.withColumns({"dt": dt, "hour": hour})


def _utc(moment: datetime) -> datetime:
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def hour_grid(spark: SparkSession, start: datetime, end: datetime, truncate: bool = False) -> DataFrame:
    """(ts, dt, hour), one row for each hour step; times without a zone are UTC."""
    start, end = _utc(start), _utc(end)
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    a, b = (F.lit(x.isoformat(" ")).cast("timestamp_ntz") for x in (start, end))
    return with_hour_key(spark.range(1).select(F.explode(hour_steps(a, b, truncate)).alias("ts")), "ts")


def grid_between(bounds: DataFrame, start: str, end: str, truncate: bool = False) -> DataFrame:
    """(ts, dt, hour) for the range that each row of ``bounds`` gives."""
    return with_hour_key(bounds.select(F.explode(hour_steps(F.col(start), F.col(end), truncate)).alias("ts")), "ts")


def hour_list(start: datetime, end: datetime, truncate: bool = False) -> list[tuple[str, str]]:
    """The same hours as (dt, hour) pairs on the driver, for filters on partitions."""
    from datetime import timedelta

    start, end = _utc(start), _utc(end)
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    now = start.replace(minute=0, second=0, microsecond=0) if truncate else start
    out = []
    while now <= end:
        out.append((now.strftime("%Y%m%d"), now.strftime("%H")))
        now += timedelta(hours=1)
    return out
