"""A stream of files by hour that lists open hours only.

Each trigger lists the folders of the hours that are open: from so many hours
before the newest one that has files, up to the present. What is found new is
written down in a log of numbered entries, and the stream's offset is the last
number, so a restarted query finds in the log what it had found and reads it as
before. Hours that are closed are not listed again, however long the archive is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from linescan.functions.matching import as_text
from linescan.sources.checked import checked_lines
from linescan.sources.listing import _passed_over
from linescan.sources.manifest import delete, file_system

SCHEMA = "value string, key string, dt string, hour string"
HOUR = timedelta(hours=1)
#: Bytes of files that one task reads, and hours that are listed at once.
TASK_BYTES, THREADS = 1 << 27, 16
ROWS = 10_000


@dataclass
class Files(InputPartition):
    """(key, dt, hour) of the files of one task."""

    files: list[tuple[str, str, str]]


@dataclass
class Settings:
    root: str
    layout: str  # of a folder below the root, with %Y %m %d %H
    log: str
    start: datetime
    end: datetime | None
    horizon: int
    max_files: int | None


class HourReader(DataSourceStreamReader):
    def __init__(self, settings: Settings):
        self.s = settings
        self.number: int | None = None  # of the last entry of the log
        self.newest: datetime | None = None
        self.seen: dict[str, set[str]] = {}  # keys by hour, of open hours

    # -- the log

    def _entry(self, number: int) -> str:
        return f"{number:012d}.json"

    def _load(self) -> None:
        from pyarrow import fs

        system, root = file_system(self.s.log)
        self.number = 0
        names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.endswith(".json"))
        for name in names:
            with system.open_input_stream(f"{root}/{name}") as stream:
                held = json.loads(stream.read())
            self._note(held)
            self.number = int(name.removesuffix(".json"))

    def _note(self, held: dict) -> None:
        for _, hour, keys in held["hours"]:
            self.seen.setdefault(hour, set()).update(k for k, _ in keys)
        self.newest = datetime.fromisoformat(held["newest"])
        lowest = self.lowest().isoformat()
        self.seen = {h: keys for h, keys in self.seen.items() if h >= lowest}

    # -- hours

    def lowest(self) -> datetime:
        """The oldest hour that is open."""
        return self.s.start if self.newest is None else max(self.s.start, self.newest - self.s.horizon * HOUR)

    def open_hours(self) -> list[datetime]:
        last = self.s.end or datetime.now(timezone.utc).replace(tzinfo=None)
        first = self.lowest()
        return [first + k * HOUR for k in range(int((last - first) / HOUR) + 1)] if last >= first else []

    def _listed(self, hour: datetime) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, base = file_system(self.s.root)
        base = base.rstrip("/")
        folder = f"{base}/{hour.strftime(self.s.layout)}"
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return [(i.path.removeprefix(f"{base}/"), i.size) for i in found if i.is_file and not any(map(_passed_over, i.path.removeprefix(f"{folder}/").split("/")))]

    # -- what Spark asks for

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        if self.number is None:
            self._load()
        hours = self.open_hours()
        with ThreadPoolExecutor(THREADS) as pool:
            listed = list(pool.map(self._listed, hours))
        room, fresh = self.s.max_files, []
        for hour, found in zip(hours, listed):
            known = self.seen.get(hour.isoformat(), ())
            new = sorted(f for f in found if f[0] not in known)[:room]
            if room is not None:
                room -= len(new)
            if new:
                fresh.append((hour, new))
        if fresh:
            newest = max([h for h, _ in fresh] + ([self.newest] if self.newest else []))
            held = {"newest": newest.isoformat(), "hours": [(h.strftime("%Y%m%d %H"), h.isoformat(), new) for h, new in fresh]}
            system, root = file_system(self.s.log)
            system.create_dir(root, recursive=True)
            name = self._entry(self.number + 1)
            with system.open_output_stream(f"{root}/.{name}.tmp") as sink:
                sink.write(json.dumps(held).encode())
            system.move(f"{root}/.{name}.tmp", f"{root}/{name}")
            self.number += 1
            self._note(held)
        return {"number": self.number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, root = file_system(self.s.log)
        out, files, size = [], [], 0
        for number in range(start["number"] + 1, end["number"] + 1):
            with system.open_input_stream(f"{root}/{self._entry(number)}") as stream:
                held = json.loads(stream.read())
            for named, _, keys in held["hours"]:
                dt, hour = named.split()
                for key, n in keys:
                    if files and size + n > TASK_BYTES:
                        out.append(Files(files))
                        files, size = [], 0
                    files.append((key, dt, hour))
                    size += n
        return [*out, Files(files)]

    def commit(self, end: dict) -> None:
        """Entries of hours that are all closed are not needed again."""
        system, root = file_system(self.s.log)
        lowest = self.lowest().isoformat()
        for number in range(end["number"] - 1, 0, -1):
            path = f"{root}/{self._entry(number)}"
            try:
                with system.open_input_stream(path) as stream:
                    held = json.loads(stream.read())
            except FileNotFoundError:  # this one and those before it are gone
                return
            if all(hour < lowest for _, hour, _ in held["hours"]):
                delete(system, path)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, base = file_system(self.s.root)
        for key, dt, hour in partition.files:
            with system.open_input_stream(f"{base.rstrip('/')}/{key}", compression=None) as stream:
                for found in checked_lines(stream, key):
                    if isinstance(found, str):
                        raise ValueError(f"{key}: {found}")
                    for k in range(0, len(found), ROWS):
                        values = as_text(pa.array(found[k : k + ROWS], pa.binary()))
                        rest = [pa.array([x] * len(values), pa.string()) for x in (key, dt, hour)]
                        yield pa.RecordBatch.from_arrays([values, *rest], ["value", "key", "dt", "hour"])


class HourFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hour_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> HourReader:
        o = self.options
        end = datetime.fromisoformat(o["end"]) if "end" in o else None
        most = int(o["maxfiles"]) if "maxfiles" in o else None
        return HourReader(Settings(o["root"], o["layout"], o["log"], datetime.fromisoformat(o["start"]), end, int(o.get("horizon", 24)), most))


def hour_stream(
    spark: SparkSession, root: str, layout: str, log: str, start: datetime, end: datetime | None = None, horizon: int = 24, max_files: int | None = None,
) -> DataFrame:
    """(value, key, dt, hour) of files that keep arriving in folders by hour, from ``start`` on, in UTC.

    ``layout`` is the folder of an hour below ``root``, such as ``dt=%Y%m%d/hour=%H``.
    An hour stays open until there are files of one that is more than ``horizon`` hours
    later; files that come after that are not read. Until ``end``, or else the present,
    later hours are looked for. ``log`` is a folder of the query's own, which belongs to
    its checkpoint: it holds what was found. ``max_files`` holds back how many files one
    trigger takes in; a query that takes what is available and stops needs to go without.
    A damaged file fails the query.
    """
    spark.dataSource.register(HourFiles)
    options = {"root": root, "layout": layout, "log": log, "start": _hour(start).isoformat(), "horizon": str(horizon)}
    if end is not None:
        options["end"] = _utc(end).isoformat()
    if max_files is not None:
        options["maxFiles"] = str(max_files)
    return spark.readStream.format("hour_files").options(**options).load()


def _utc(moment: datetime) -> datetime:
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def _hour(moment: datetime) -> datetime:
    return _utc(moment).replace(minute=0, second=0, microsecond=0)
