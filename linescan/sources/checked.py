"""Lines of objects that may be damaged, and a report of which were.

Each object is read by itself in a task, so one that is cut short, is not what its
name says or is gone costs its own lines at most. What Spark's own reader passes
over in silence (``skip_bad``) comes with its key, the number of lines that were
kept and what was wrong.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescan.functions.matching import as_text
from linescan.sources.manifest import file_system

CHUNK = 1 << 20
ROWS = 10_000
CHECKED_SCHEMA = "key string, value string, lines long, error string"


class Damaged(ValueError):
    pass


def unpacked(stream, begin: Callable, bad: type[Exception]) -> Iterator[bytes]:
    """Plain text of members or frames that lie behind one another; ``begin`` makes what unpacks one."""
    held, now = b"", None
    while held or (held := stream.read(CHUNK)):
        now = now or begin()
        try:
            text = now.decompress(held)
        except bad as error:
            raise Damaged(str(error)) from None
        held = now.unused_data
        if text:
            yield text
        if now.eof:
            now = None
    if now is not None:
        raise Damaged("cut short")


def plain_chunks(stream, name: str) -> Iterator[bytes]:
    """The text of an object, unpacked as its name says."""
    if name.endswith(".gz"):
        yield from unpacked(stream, lambda: zlib.decompressobj(31), zlib.error)
    elif name.endswith((".zst", ".zstd")):
        import zstandard

        yield from unpacked(stream, lambda: zstandard.ZstdDecompressor().decompressobj(), zstandard.ZstdError)
    else:
        while text := stream.read(CHUNK):
            yield text


def checked_lines(stream, name: str) -> Iterator[list[bytes] | str]:
    """Lines in groups; then, if the object is damaged, what is wrong. A line that the damage cuts is not kept."""
    parts: list[bytes] = []  # of a line that is not at its end
    try:
        for text in plain_chunks(stream, name):
            head, newline, rest = text.rpartition(b"\n")
            if not newline:
                parts.append(text)
                continue
            yield b"".join([*parts, head]).split(b"\n")
            parts = [rest] if rest else []
    except (Damaged, OSError) as error:
        yield f"{type(error).__name__}: {error}"
        return
    if parts:
        yield [b"".join(parts)]


def read_checked(spark: SparkSession, root: str, catalog: DataFrame, opened: Callable = file_system) -> DataFrame:
    """(key, value, lines, error) of the objects of a catalog (key, relative to ``root``).

    A row for each line, of which lines and error are null, and one without a value
    for each object that is damaged or missing: the number of its lines that were
    kept and what was wrong. An object is read once, repeated and null keys are
    passed over. Plain, gzip and zstd are told apart by the suffix; lines may hold
    any bytes.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)

        def batch(key: str, values: pa.Array, lines: int | None, error: str | None) -> pa.RecordBatch:
            n = len(values)
            columns = [pa.array([key] * n, pa.string()), values, pa.array([lines] * n, pa.int64()), pa.array([error] * n, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["key", "value", "lines", "error"])

        for keys in batches:
            for key in keys.column("key").to_pylist():
                kept, error = 0, None
                try:
                    with system.open_input_stream(f"{base.rstrip('/')}/{key}", compression=None) as stream:
                        for found in checked_lines(stream, key):
                            if isinstance(found, str):
                                error = found
                                break
                            for k in range(0, len(found), ROWS):
                                yield batch(key, as_text(pa.array(found[k : k + ROWS], pa.binary())), None, None)
                            kept += len(found)
                except OSError as problem:
                    error = f"{type(problem).__name__}: {problem}"
                if error is not None:
                    yield batch(key, pa.array([None], pa.string()), kept, error)

    tasks = spark.sparkContext.defaultParallelism
    keys = catalog.select("key").where("key IS NOT NULL").distinct().repartition(4 * tasks, "key")
    return keys.mapInArrow(read, CHECKED_SCHEMA)


def sound_lines(checked: DataFrame) -> DataFrame:
    """(key, value): the lines that were kept, those of damaged objects before the damage too."""
    return checked.where("error IS NULL").select("key", "value")


def damage_report(checked: DataFrame) -> DataFrame:
    """(key, lines, error): one row for each object that is damaged or missing."""
    return checked.where(F.col("error").isNotNull()).select("key", "lines", "error")
