"""The search over files that keep arriving."""

from __future__ import annotations

import json
import threading
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from linescan.plans.search import match_lines
from linescan.sources.http_lines import HttpLines, payload
from linescan.sources.manifest import delete, file_system
from linescan.sources.zstd_lines import write_lines

LOG_SCHEMA = "query_id string, run_id string, name string, batch_id long, at string, input_rows long, matches long, plaintext_bytes long, rows_per_second double, batch_ms long"
PROGRESS_SCHEMA = "query string, batch_id long, input_rows long, matches long, plaintext_bytes long, rows_per_second double, batch_ms long"


def line_stream(spark: SparkSession, root: str, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(value, dt, hour) of a growing tree ``dt=/hour=``; the limits hold back how much one trigger takes in."""
    reader = spark.readStream.schema("value string, dt string, hour string").option("lineSep", "\n")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.text(root)


def search_stream(lines: DataFrame, pattern: str | None, ignore_case: bool = False) -> DataFrame:
    """Matching lines of a stream, watched under the name ``matched``."""
    found = match_lines(lines, pattern, ignore_case)
    return found.observe("matched", F.count(F.lit(1)).alias("matches"), F.sum(F.octet_length("value") + 1).alias("plaintext_bytes"))


def to_files(found: DataFrame, directory: str, checkpoint: str, level: int = 3, available_now: bool = True) -> StreamingQuery:
    """zstd files by prefix below a folder for each trigger; a repeated trigger replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_lines(batch.withColumn("prefix", F.concat_ws("/", "dt", "hour")), f"{directory}/batch={batch_id}", level)

    writer = found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_table(found: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Parquet rows, exactly once."""
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_http(found: DataFrame, url: str, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Posted batches, at least once."""
    found.sparkSession.dataSource.register(HttpLines)
    writer = payload(found).writeStream.format("http_lines").options(url=url, **{k: str(v) for k, v in options.items()})
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress_row(p) -> tuple:
    """The measures of one trigger."""
    seen = p.observedMetrics.get("matched")
    matches, size = (seen["matches"], seen["plaintext_bytes"]) if seen else (None, None)
    return p.name or str(p.id), p.batchId, p.numInputRows, matches, size, p.processedRowsPerSecond, p.batchDuration


def progress_table(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The measures of a query's latest triggers (spark.sql.streaming.numRecentProgressUpdates of them)."""
    return spark.createDataFrame([progress_row(p) for p in query.recentProgress], PROGRESS_SCHEMA)


class ProgressRows(StreamingQueryListener):
    """Keeps the measures of the latest triggers: rows in, matches, bytes, rates."""

    def __init__(self, most: int = 10_000):
        self.rows: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows.append(progress_row(event.progress))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), PROGRESS_SCHEMA)


class ProgressLog(StreamingQueryListener):
    """Puts the measures of every trigger of every query into a folder, a file for each, as they come.

    A file is named by query, run and batch, so a trigger that is told of twice is
    there once. When a run ends its files become one. Nothing is held in memory, and
    a driver that dies loses no trigger that was told of.
    """

    def __init__(self, path: str):
        self.path = path
        self.ended: dict[str, threading.Event] = {}

    def _put(self, name: str, rows: list[dict]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/.{name}.tmp") as sink:
            sink.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        system.move(f"{root}/.{name}.tmp", f"{root}/{name}.json")

    def _run(self, run_id) -> threading.Event:
        return self.ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:
        self._run(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name, batch_id, input_rows, matches, size, rate, took = progress_row(p)
        row = {"query_id": str(p.id), "run_id": str(p.runId), "name": name, "batch_id": batch_id, "at": p.timestamp, "input_rows": input_rows, "matches": matches}
        rate = rate if rate is not None and rate == rate and abs(rate) != float("inf") else None  # JSON has no other numbers
        self._put(f"{p.id}-{p.runId}-{batch_id:012d}", [row | {"plaintext_bytes": size, "rows_per_second": rate, "batch_ms": took}])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        try:
            self._gather(str(event.id), str(event.runId))
        finally:
            self._run(event.runId).set()

    def _gather(self, query_id: str, run_id: str) -> None:
        """One file in place of a run's; between the two its rows are there twice, which ``progress_log`` mends."""
        from pyarrow import fs

        system, root = file_system(self.path)
        start = f"{query_id}-{run_id}-"
        names = [i.path for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith(start) and i.base_name.endswith(".json")]
        rows = []
        for f in sorted(names):
            with system.open_input_stream(f) as stream:
                rows += [json.loads(line) for line in stream.read().splitlines()]
        if rows:
            self._put(f"{query_id}-{run_id}", rows)
        for f in names:
            delete(system, f)

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until all triggers of a run that ended are in the log; TimeoutError if they are not in time."""
        if not self._run(query.runId).wait(seconds):
            raise TimeoutError(f"run {query.runId} has not been told to have ended")


def progress_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a ``ProgressLog``: one for each query and batch, the later one where a restarted query ran a batch again."""
    rows = spark.read.schema(LOG_SCHEMA).json(path)
    latest = F.max_by(F.struct(*rows.columns), F.struct("at", "run_id")).alias("row")
    return rows.groupBy("query_id", "batch_id").agg(latest).select("row.*")
