"""Sink ``http_lines``: lines posted in zstd batches.

Every task packs its own lines and sends them; there is no shuffle. Delivery is
at least once: a task that Spark runs again sends again. The first refusal leaves
a mark in the shared folder, at which all other tasks stop sending. A destination
that is no ``http`` address is a folder, into which batches are put as files.
Every try may leave a row in a delivery log.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from linescan.functions.delivery import FIRST_DELAY_MS, response_class, retries_allowed
from linescan.session import scratch
from linescan.sources.manifest import delete, file_system

LEAST_RATE = 2_000_000.0
LEASE_SECONDS, STALE_SECONDS = 2.0, 60.0
STATS_SCHEMA = "lines_sent long, lines_dropped long, batches_sent long, plaintext_bytes_sent long, compressed_bytes_sent long, seconds double, rate_cuts long, fatal string"
#: A row for each try: ``began`` and ``took`` in seconds of the task's own clock, ``status`` null where nobody answered.
LOG_SCHEMA = (
    "run string, task int, attempt long, batch long, try int, status int, retry_after double, error string, lines long, plaintext_bytes long, "
    "compressed_bytes long, began double, took double"
)
LOG_ROWS = 10_000


@dataclass
class Settings:
    url: str
    token: str | None = field(default=None, repr=False)
    timeout: float = 30.0
    max_batch_bytes: int = 2 * 1024 * 1024
    level: int = 3
    max_retries: int = 1
    max_rate: float | None = None
    lease_path: str | None = None
    max_submission_time: float | None = None
    run: str = field(default_factory=lambda: uuid.uuid4().hex)
    decrease: float = 0.15
    increase: float = 1_000_000.0
    stats_path: str | None = None
    stop_path: str | None = None
    log_path: str | None = None
    fail_on_drop: bool = False

    @classmethod
    def of(cls, options: dict) -> Settings:
        """From string options. ``tokenEnv`` names the variable that holds the bearer token; ``tasks`` says
        how many tasks send at once, among which the rate is divided; without it they find out by leases."""
        number = lambda k, d: float(options[k]) if k in options else d
        rate = number("maxRate", None)
        return cls(
            url=options["url"], token=os.environ.get(options["tokenEnv"]) if "tokenEnv" in options else options.get("token"),
            timeout=number("timeout", 30.0), max_batch_bytes=int(number("maxBatchBytes", 2 * 1024 * 1024)), level=int(number("level", 3)),
            max_retries=retries_allowed(int(number("maxRetries", 1))), max_rate=rate / max(1.0, number("tasks", 1.0)) if rate else None,
            max_submission_time=number("maxSubmissionTime", None), decrease=number("decrease", 0.15), increase=number("increase", 1_000_000.0),
            stats_path=options.get("statsPath"), stop_path=options.get("stopPath"), log_path=options.get("logPath"), lease_path=options.get("leasePath"), fail_on_drop=options.get("failOnDrop", "false").lower() == "true",
        )


class Leases:
    """The tasks that send just now, as files in a shared folder; one that has not renewed its own for STALE_SECONDS is gone."""

    def __init__(self, path: str):
        self.system, root = file_system(path)
        self.root, self.own = root.rstrip("/"), uuid.uuid4().hex

    def renew(self) -> None:
        self.system.create_dir(self.root, recursive=True)
        with self.system.open_output_stream(f"{self.root}/{self.own}") as sink:
            sink.write(b"lease")

    def live(self) -> int:
        """How many there are, this one included, by the clock of the folder."""
        from pyarrow import fs

        times = {i.base_name: i.mtime_ns for i in self.system.get_file_info(fs.FileSelector(self.root, allow_not_found=True))}
        now = times.get(self.own, max(times.values(), default=0))
        return max(1, sum(now - t < STALE_SECONDS * 1e9 for t in times.values()))

    def drop(self) -> None:
        delete(self.system, f"{self.root}/{self.own}")


class Pacer:
    """A task's share of the upload rate: a bucket of two batches, filled at ``rate`` bytes a second.

    With ``leases`` the share is an equal part among the tasks that send just now. It is
    looked at again every LEASE_SECONDS; a task that comes begins with an empty bucket
    once the others have seen it, so all shares together never pass the cap, and what a
    task that ends leaves goes to the others.

    With a submission time to hold, the rate adapts: a slow or refused batch takes
    a share off, at most once in a while and never below LEAST_RATE; a quick one
    adds a step, up to a ceiling. Until the first slow batch an uncapped task is
    free, and then starts from what it has reached so far.
    """

    def __init__(self, settings: Settings, clock=time.monotonic, sleep=time.sleep, leases: Leases | None = None):
        self.s, self.clock, self.sleep, self.leases = settings, clock, sleep, leases
        self.rate = settings.max_rate
        self.ceiling = settings.max_rate
        self.room = self.left = 2.0 * settings.max_batch_bytes
        self.began = self.filled = clock()
        self.lowered = self.looked = None
        self.sent = self.cuts = 0

    def _share(self) -> None:
        """Take the part of the cap that is this task's now."""
        now = self.clock()
        if self.looked is None:
            self.leases.renew()
            self.sleep(LEASE_SECONDS)  # by then the others have looked
            now = self.clock()
            self.left, self.filled = 0.0, now
        elif now - self.looked < LEASE_SECONDS:
            return
        self.left = min(self.room, self.left + (now - self.filled) * self.rate)
        self.filled = self.looked = now
        self.leases.renew()
        held_back = self.rate < self.ceiling  # by the adaptive rate
        self.ceiling = self.s.max_rate / self.leases.live()
        self.rate = min(self.rate, self.ceiling) if held_back else self.ceiling

    def close(self) -> None:
        if self.leases is not None:
            self.leases.drop()

    def wait(self, size: int) -> None:
        if self.rate is None:
            return
        if self.leases is not None:
            self._share()
            # Never asleep for longer than a share lasts.
            while (short := size - self.left - (self.clock() - self.filled) * self.rate) > self.rate * LEASE_SECONDS:
                self.sleep(LEASE_SECONDS)
                self.room = max(self.room, size)
                self._share()
        now = self.clock()
        self.left = min(self.room, self.left + (now - self.filled) * self.rate)
        self.filled = now
        if self.left < size:
            pause = (size - self.left) / self.rate
            self.sleep(pause)
            self.filled, self.left = self.clock(), float(size)
        self.left -= size

    def lower(self) -> bool:
        if self.s.max_submission_time is None and self.s.max_rate is None:
            return False
        now = self.clock()
        if self.lowered is not None and now - self.lowered < max(1.0, (self.s.max_submission_time or 0) / 2):
            return False
        if self.rate is None:
            # What was reached so far; before anything was sent, ten times the least.
            self.ceiling = self.sent / max(now - self.began, 1e-3) if self.sent else 10 * LEAST_RATE
            self.rate = self.ceiling * (1 - self.s.decrease)
        else:
            self.rate = max(self.rate * (1 - self.s.decrease), min(LEAST_RATE, self.ceiling))
        self.left, self.filled, self.lowered = 0.0, now, now
        self.cuts += 1
        return True

    def done(self, size: int, seconds: float) -> None:
        self.sent += size
        if self.s.max_submission_time is None:
            return
        if seconds > self.s.max_submission_time:
            self.lower()
        elif self.rate is not None and self.ceiling:
            self.rate = min(self.rate + self.s.increase, self.ceiling)


@dataclass
class Delivered(WriterCommitMessage):
    lines_sent: int = 0
    lines_dropped: int = 0
    batches_sent: int = 0
    plaintext_bytes_sent: int = 0
    compressed_bytes_sent: int = 0
    seconds: float = 0.0
    rate_cuts: int = 0
    fatal: str | None = None


def put(settings: Settings, body: bytes) -> tuple[int | None, float | None, str]:
    """The same for a folder: a new file of its own for each batch, seen once it is whole."""
    name = uuid.uuid4().hex
    try:
        system, root = file_system(settings.url)
        hidden = f"{root.rstrip('/')}/.{name}.tmp"
        with system.open_output_stream(hidden, compression=None) as sink:
            sink.write(body)
        system.move(hidden, f"{root.rstrip('/')}/{name}.zst")
    except FileNotFoundError as error:
        return 404, None, str(error)
    except PermissionError as error:
        return 403, None, str(error)
    except OSError as error:
        return None, None, str(error)
    return 201, None, ""


def post(settings: Settings, body: bytes) -> tuple[int | None, float | None, str]:
    """Status (None: no answer), Retry-After in seconds, and what was answered."""
    if not settings.url.lower().startswith(("http://", "https://")):
        return put(settings, body)
    headers = {"Content-Type": "application/x-ndjson", "Content-Encoding": "zstd"}
    if settings.token:
        headers["Authorization"] = f"Bearer {settings.token}"
    request = urllib.request.Request(settings.url, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=settings.timeout) as answer:
            return answer.status, None, ""
    except urllib.error.HTTPError as error:
        after = error.headers.get("Retry-After")
        try:
            seconds = max(0.0, float(after)) if after else None
        except ValueError:
            seconds = None
        return error.code, seconds, error.read(2000).decode("utf-8", "replace")
    except OSError as error:
        return None, None, str(error)


class Stop:
    """A mark in the shared folder: some task was refused. A single check for each batch of megabytes."""

    def __init__(self, path: str | None):
        self.path = path

    def is_set(self) -> bool:
        if not self.path:
            return False
        from pyarrow import fs

        system, path = file_system(self.path)
        return system.get_file_info(path).type != fs.FileType.NotFound

    def set(self) -> None:
        if self.path:
            system, path = file_system(self.path)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path) as out:
                out.write(b"refused")


class Sender:
    """Sends one task's batches; waits between tries, and counts what becomes of the lines."""

    def __init__(self, settings: Settings, sleep=time.sleep):
        self.s, self.sleep = settings, sleep
        shared = settings.max_rate is not None and settings.lease_path is not None
        self.pacer = Pacer(settings, sleep=sleep, leases=Leases(settings.lease_path) if shared else None)
        self.stop = Stop(settings.stop_path)
        self.out = Delivered()
        context = TaskContext.get()
        self.task = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        self.began, self.batch, self.rows = time.monotonic(), 0, []

    def log(self, *row) -> None:
        if self.s.log_path:
            self.rows.append((self.s.run, *self.task, self.batch, *row))
            if len(self.rows) >= LOG_ROWS:
                self.write_log()

    def write_log(self) -> None:
        """Put the rows so far into the log, whatever becomes of the task: the tries were made."""
        if self.rows:
            import pyarrow.parquet as pq

            system, root = file_system(self.s.log_path)
            system.create_dir(root, recursive=True)
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
            fields = [f.split() for f in LOG_SCHEMA.split(", ")]
            made = pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*self.rows), fields)], [n for n, _ in fields])
            name = f"{self.s.run}-{self.task[0]}-{uuid.uuid4().hex}"
            pq.write_table(made, f"{root}/.{name}.tmp", filesystem=system)
            system.move(f"{root}/.{name}.tmp", f"{root}/{name}.parquet")
            self.rows = []

    def send(self, body: bytes, lines: int, plain: int) -> None:
        if self.out.fatal or self.stop.is_set():
            self.out.lines_dropped += lines
            return
        refused = failed = tries = 0
        self.batch += 1
        while True:
            self.pacer.wait(len(body))
            began = time.monotonic()
            status, after, said = post(self.s, body)
            took = time.monotonic() - began
            self.out.seconds += took
            tries += 1
            self.log(tries, status, after, said or None, lines, plain, len(body), began - self.began, took)
            kind = response_class(status)
            if kind == "ok":
                self.pacer.done(len(body), took)
                self.out.lines_sent += lines
                self.out.batches_sent += 1
                self.out.plaintext_bytes_sent += plain
                self.out.compressed_bytes_sent += len(body)
                return
            if kind == "fatal":
                self.out.fatal = f"HTTP {status}: {said}"
                self.stop.set()
            elif kind == "throttled":
                self.pacer.lower()
                refused += 1
                failed = 0
            else:
                failed += 1
            # Refusals and failures are counted apart.
            if kind == "fatal" or refused > self.s.max_retries or failed > self.s.max_retries:
                self.out.lines_dropped += lines
                return
            own = FIRST_DELAY_MS / 1000 * 2 ** ((refused if kind == "throttled" else failed) - 1)
            self.sleep(own if after is None else after)


def send_all(settings: Settings, batches: Iterator[pa.RecordBatch]) -> Delivered:
    """Pack and send the lines: a batch closes once its compressed size reaches the limit, the last one at the end."""
    import zstandard

    sender = Sender(settings)
    limit = settings.max_batch_bytes
    packer, parts, size, pending, lines, plain = None, [], 0, 0, 0, 0
    try:
        for batch in batches:
            values = batch.column("value").drop_null()
            ends = np.cumsum(pc.add(pc.binary_length(values), 1).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(values):
                if packer is None:
                    packer, parts, size, pending, lines, plain = zstandard.ZstdCompressor(level=settings.level).compressobj(), [], 0, 0, 0, 0
                # As many lines at once as cannot fill the batch even if nothing of them is saved; at least one.
                done = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + limit - size - pending)))
                text = b"\n".join([*values.slice(at, stop - at).to_pylist(), b""])
                part = packer.compress(text)
                lines, plain, pending, at = lines + stop - at, plain + len(text), 0 if part else pending + len(text), stop
                if size + pending >= limit:
                    # What the compressor holds back may fill the batch.
                    part, pending = part + packer.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK), 0
                if part:
                    parts.append(part)
                    size += len(part)
                if size >= limit:
                    sender.send(b"".join([*parts, packer.flush()]), lines, plain)
                    packer = None
        if packer is not None:
            sender.send(b"".join([*parts, packer.flush()]), lines, plain)
    finally:
        sender.pacer.close()
        sender.write_log()
    sender.out.rate_cuts = sender.pacer.cuts
    return sender.out


def total(messages: list[Delivered | None]) -> Delivered:
    out = Delivered()
    for m in messages:
        if m:
            for name in ("lines_sent", "lines_dropped", "batches_sent", "plaintext_bytes_sent", "compressed_bytes_sent", "seconds", "rate_cuts"):
                setattr(out, name, getattr(out, name) + getattr(m, name))
            out.fatal = out.fatal or m.fatal
    return out


def finish(settings: Settings, messages: list[Delivered | None]) -> None:
    """Write the counts down, then fail the job if a task met a fatal answer.

    The failure comes from here and not from the task, which Spark would run and send again.
    """
    out = total(messages)
    if settings.stats_path:
        system, root = file_system(settings.stats_path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/stats-{uuid.uuid4().hex}.json") as sink:
            sink.write(json.dumps(asdict(out)).encode())
    if out.fatal:
        raise RuntimeError(f"delivery was refused: {out.fatal}")
    if settings.fail_on_drop and out.lines_dropped:
        raise RuntimeError(f"{out.lines_dropped} lines were dropped")


class HttpLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_lines"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return HttpLinesWriter(Settings.of(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return HttpLinesStreamWriter(Settings.of(self.options))


class HttpLinesWriter(DataSourceArrowWriter):
    def __init__(self, settings: Settings):
        self.settings = settings

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Delivered:
        return send_all(self.settings, iterator)

    def commit(self, messages: list[Delivered | None]) -> None:
        finish(self.settings, messages)


class HttpLinesStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, settings: Settings):
        self.settings = settings

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Delivered:
        return send_all(self.settings, iterator)

    def commit(self, messages: list[Delivered | None], batchId: int) -> None:
        finish(self.settings, messages)

    def abort(self, messages: list[Delivered | None], batchId: int) -> None:
        pass


def payload(lines: DataFrame) -> DataFrame:
    """Just the lines, as bytes."""
    return lines.select(F.col("value").cast("binary").alias("value"))


def write_http(lines: DataFrame, url: str, **options) -> None:
    """Post the lines of ``value`` to an address, or put them into a folder that is there. Options are those of
    ``Settings.of``: tokenEnv, timeout, maxBatchBytes, level, maxRetries (10 at most), maxRate,
    tasks, maxSubmissionTime, statsPath, failOnDrop; logPath is a folder that gets a row for every try, see
    ``delivery_log``; stopPath is where the first refusal leaves its mark, a new path in the shared folder
    unless given. The rate is shared by the tasks that send at a time, by leases in the shared folder, or divided by
    ``tasks``."""
    lines.sparkSession.dataSource.register(HttpLines)
    options.setdefault("stopPath", scratch(lines.sparkSession, "stop"))
    if "maxRate" in options and "tasks" not in options:
        options.setdefault("leasePath", scratch(lines.sparkSession, "leases"))
    payload(lines).write.format("http_lines").options(url=url, **{k: str(v) for k, v in options.items()}).mode("append").save()


def delivery_stats(spark: SparkSession, stats_path: str) -> DataFrame:
    """The counts of all runs that wrote to ``stats_path``, one row each."""
    return spark.read.schema(STATS_SCHEMA).json(stats_path)


def delivery_log(spark: SparkSession, log_path: str) -> DataFrame:
    """A row for every try of all runs with this ``logPath``, those of tasks that failed or ran again too: see ``LOG_SCHEMA``."""
    return spark.read.schema(LOG_SCHEMA).parquet(log_path)
