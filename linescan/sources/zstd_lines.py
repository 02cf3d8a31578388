"""Sink ``zstd_lines``: lines as zstd text, one file for each prefix.

Spark writes text with its own codecs only, zstd is not among them; this writer
compresses in the tasks. A task gets whole prefixes, sorted, and holds one open
file at a time; a prefix too large for a task is split by adaptive execution and
becomes several files. Tasks write beside the output folder, and the commit, a
manifest that is swapped, says which files count: see ``manifest``. The writer
counts what it writes, so no figure needs a second look at the lines or at the
folder.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from linescan.sources.frames import FRAME_BYTES, FrameWriter
from linescan.sources.manifest import Entry, Folder, current_files, delete, file_system

DEFAULT_LEVEL = 3
#: Where lines without a prefix go.
NO_PREFIX = "__null__"
WRITTEN_SCHEMA = "prefix string, file string, lines long, plaintext_bytes long, compressed_bytes long"


#: Segments of a prefix: Spark's readers pass over names that begin with a point or an underscore.
GOOD_PREFIX = r"^(?:[^/._\x00-\x1f][^/\x00-\x1f]*)(?:/[^/._\x00-\x1f][^/\x00-\x1f]*)*$"


@dataclass
class WrittenFile:
    hidden: str
    prefix: str
    lines: int = 0
    plaintext_bytes: int = 0
    compressed_bytes: int = 0
    part: int | None = None


@dataclass
class Written(WriterCommitMessage):
    files: list[WrittenFile]


class ZstdLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ZstdLinesWriter(self.options["path"], int(self.options.get("level", DEFAULT_LEVEL)), self.options.get("statspath"), int(self.options.get("framebytes", FRAME_BYTES)))


def same_runs(column: pa.Array) -> list[tuple[int, int]]:
    """(start, end) of the runs of one value in a column without nulls."""
    if len(column) == 0:
        return []
    new = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(column)]
    return list(zip(edges, edges[1:]))


class ZstdLinesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, level: int, stats_path: str | None = None, frame_bytes: int = FRAME_BYTES):
        if not 1 <= level <= 22:
            raise ValueError("zstd levels are 1 to 22")
        self.path, self.level, self.stats_path, self.frame_bytes = path, level, stats_path, frame_bytes
        self.run = uuid.uuid4().hex  # one for all tasks of this write

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = Folder(self.path)
        system, waiting = folder.system, folder.staging(self.run)
        attempt, done = uuid.uuid4().hex, []
        sink = stream = None

        def close() -> None:
            if sink is not None:
                stream.close()
                done[-1].compressed_bytes = sink.tell()
                sink.close()

        try:
            for batch in iterator:
                names, parts = batch.column("name"), batch.column("part")
                edges = sorted({e for c in (names, parts) for run in same_runs(c) for e in run})
                for a, b in zip(edges, edges[1:]):
                    key = (names[a].as_py(), parts[a].as_py() if parts[a].as_py() >= 0 else None)
                    if not done or key != (done[-1].prefix, done[-1].part):
                        close()
                        system.create_dir(waiting, recursive=True)
                        done.append(WrittenFile(f"{waiting}/{attempt}-{len(done)}.zst", key[0], part=key[1]))
                        sink = system.open_output_stream(done[-1].hidden, compression=None)
                        stream = FrameWriter(sink, self.level, self.frame_bytes)
                    text = b"\n".join([*batch.column("value").slice(a, b - a).to_pylist(), b""])
                    stream.write(text)
                    done[-1].lines += b - a
                    done[-1].plaintext_bytes += len(text)
            close()
        except BaseException:
            for f in done:
                delete(system, f.hidden)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        by_key = defaultdict(list)
        for message in messages:
            for f in message.files if message else []:
                by_key[f.prefix, f.part].append(f)
        names = folder.names_for({k: len(files) for k, files in by_key.items()}, folder.latest())
        entries = [
            Entry(f.prefix, name, f.lines, f.plaintext_bytes, f.compressed_bytes, f.hidden)
            for key, files in by_key.items() for f, name in zip(sorted(files, key=lambda f: f.hidden), names[key])
        ]
        if entries:
            folder.commit(self.run, entries)
        self._clear(folder)
        if self.stats_path:
            rows = [{"prefix": e.prefix, "file": e.file, "lines": e.lines, "plaintext_bytes": e.plaintext_bytes, "compressed_bytes": e.compressed_bytes} for e in entries]
            stats, path = file_system(self.stats_path)
            stats.create_dir(path, recursive=True)
            with stats.open_output_stream(f"{path}/written-{self.run}.json") as out:
                out.write("".join(json.dumps(r) + "\n" for r in rows).encode())

    def _clear(self, folder: Folder) -> None:
        """Remove what attempts of this write left that did not come to be counted."""
        from pyarrow import fs

        folder.drop_staging(self.run)
        for info in folder.system.get_file_info(fs.FileSelector(folder.root, allow_not_found=True)):
            if f".{self.run}." in info.base_name:
                delete(folder.system, info.path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(Folder(self.path))


def write_lines(
    lines: DataFrame, directory: str, level: int = DEFAULT_LEVEL, by_bucket: bool = False, parts: int = 1, stats_path: str | None = None,
    frame_bytes: int = FRAME_BYTES,
) -> None:
    """Write (prefix, value) lines to ``directory/prefix.zst``; ``value`` may be text or bytes.

    What was there of the prefixes present is replaced, whatever its number of files;
    files of other prefixes and those that no write made stay, but for one that has
    the very name of a new file. Lines with a null value are no lines; lines with a
    null prefix go to ``__null__.zst``. A prefix that is no path of plain names (an
    empty name, ``..``, one that begins with a point or an underscore, a control
    character) is an error. ``by_bucket`` puts a folder of the bucket in front, else
    buckets share a prefix's file. A prefix that adaptive execution splits becomes
    ``prefix.part-k.zst``; ``parts`` above 1 deals every prefix to so many files
    ``prefix-k.zst``; names of another prefix's files are passed over. ``stats_path``
    is a folder that gets a row for each file written, see ``written_files``. A file of
    more than ``frame_bytes`` of text has several frames and a seek table, so that
    ``read_frames`` reads it by many tasks. A write
    counts as a whole or not at all for those who read by ``read_written``.
    """
    spark = lines.sparkSession
    spark.dataSource.register(ZstdLines)
    name = F.concat_ws("/", "bucket", F.coalesce("prefix", F.lit(NO_PREFIX))) if by_bucket else F.col("prefix")
    good = name.isNull() | name.rlike(GOOD_PREFIX) | F.col("prefix").isNull()
    name = F.when(good, F.coalesce(name, F.lit(NO_PREFIX))).otherwise(F.raise_error(F.concat(F.lit("not a prefix for files: '"), name, F.lit("'"))))
    part = F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int") if parts > 1 else F.lit(-1)
    rows = lines.where("value IS NOT NULL").select(name.alias("name"), part.alias("part"), F.col("value").cast("binary").alias("value"))
    dealt = spark.sql("SELECT /*+ REBALANCE(name, part) */ name, part, value FROM {rows}", rows=rows).sortWithinPartitions("name", "part")
    writer = dealt.write.format("zstd_lines").option("level", level).option("frameBytes", frame_bytes)
    if stats_path:
        writer = writer.option("statsPath", stats_path)
    writer.mode("append").save(directory)


def read_written(spark: SparkSession, directory: str) -> DataFrame:
    """(prefix, value) of the lines that count in an output folder: all of each write or nothing, even beside a write that stopped."""
    from linescan.sources.lines import file_path, literal_path, read_lines

    files = current_files(spark, directory)
    paths = [r.path for r in files.select("path").collect()]  # a path for each file, as Spark's own list of files has
    if not paths:
        return spark.createDataFrame([], "prefix string, value string")
    lines = read_lines(spark, [literal_path(p) for p in paths])
    bare = lambda path: F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    return lines.withColumn("path", bare(file_path())).join(files.select("prefix", bare("path").alias("path")), "path").select("prefix", "value")


def written_files(spark: SparkSession, stats_path: str) -> DataFrame:
    """(prefix, file, lines, plaintext_bytes, compressed_bytes) of the files that writes with this ``stats_path`` put in place."""
    return spark.read.schema(WRITTEN_SCHEMA).json(stats_path)


def write_partitioned(lines: DataFrame, directory: str, form: str = "text", compression: str = "gzip") -> None:
    """(dt, hour, value) lines to folders ``dt=/hour=`` in a format that Spark writes by itself; partitions present are replaced."""
    rows = lines.select("dt", "hour", "value").repartition("dt", "hour")
    writer = rows.write.option("compression", compression).option("lineSep", "\n").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dt", "hour").mode("overwrite").format(form).save(directory)
