"""Large zstd files read by many tasks: independent frames, and a table at the end that says where they are.

The sink ends a frame at a line's end now and then, and closes a file of several
frames with the seek table of the seekable zstd format, a skippable frame that
other readers pass over. Here the tables are read by tasks, frames are grouped to
splits, and splits are dealt out. A line belongs to the split in which the byte
before it lies, so lines may cross frames: a split passes over what it finds before
its first newline, and reads on to the end of its last line.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescan.functions.matching import as_text
from linescan.sources.manifest import file_system

# Fixed values of the seekable zstd format.
TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Plain bytes of a frame that the sink writes, and of a split.
FRAME_BYTES, SPLIT_BYTES = 1 << 24, 1 << 27
CHUNK = 1 << 22


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The last frame of a file whose frames have these (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", TABLE_MAGIC, len(body)) + body


def read_seek_table(stream, size: int) -> list[tuple[int, int]] | None:
    """(compressed, plain) sizes of all frames of a file of ``size`` bytes; None if it has no table or one that does not fit."""
    if size < 17:
        return None
    stream.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE_MAGIC or flags & 0x7C:
        return None
    entry = 12 if flags & 0x80 else 8  # with checksums, which are not looked at
    whole = 8 + n * entry + 9
    if whole > size:
        return None
    stream.seek(size - whole)
    held = stream.read(whole)
    if struct.unpack_from("<II", held) != (TABLE_MAGIC, whole - 8):
        return None
    sizes = [struct.unpack_from("<II", held, 8 + i * entry) for i in range(n)]
    return sizes if sum(c for c, _ in sizes) == size - whole else None


class FrameWriter:
    """Lines to zstd frames that end where a line does; a small file is one frame."""

    def __init__(self, sink, level: int, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.sink, self.most = sink, frame_bytes
        self.stream = zstandard.ZstdCompressor(level=level).stream_writer(sink, closefd=False)
        self.end_frame = zstandard.FLUSH_FRAME
        self.plain = self.began = 0
        self.sizes: list[tuple[int, int]] = []

    def write(self, text: bytes) -> None:
        """Add whole lines; a line that is longer than a frame gets one of its own."""
        at, held = 0, memoryview(text)
        while at < len(text):
            end = len(text)
            if end - at > self.most - self.plain:
                end = text.rfind(b"\n", at, at + max(0, self.most - self.plain)) + 1
                if end <= at and self.plain:
                    self._end_frame()
                    continue
                if end <= at:
                    end = text.find(b"\n", at) + 1 or len(text)
            self.stream.write(held[at:end])
            self.plain += end - at
            at = end

    def _end_frame(self) -> None:
        self.stream.flush(self.end_frame)
        self._note()

    def _note(self) -> None:
        at = self.sink.tell()
        self.sizes.append((at - self.began, self.plain))
        self.began, self.plain = at, 0

    def close(self) -> None:
        self.stream.close()
        self._note()
        if len(self.sizes) > 1 and all(max(s) < 1 << 32 for s in self.sizes):
            self.sink.write(seek_table(self.sizes))


def splits(sizes: list[tuple[int, int]], split_bytes: int) -> list[tuple[int, int]]:
    """(offset in the file, plain bytes) of groups of frames of about ``split_bytes`` each."""
    out, at, start, plain = [], 0, 0, 0
    for packed, size in sizes:
        if plain and plain + size > split_bytes:
            out.append((start, plain))
            start, plain = at, 0
        at, plain = at + packed, plain + size
    return [*out, (start, plain)] if plain else out


def split_lines(stream, first: bool, length: int | None) -> Iterator[list[bytes]]:
    """The lines that belong to a split of ``length`` plain bytes (None: to the end), of which the file's first one keeps its beginning."""
    held, at = b"", 0  # text from the plain position ``at`` on
    begun = first
    while True:
        new = stream.read(CHUNK)
        held += new
        if not begun:
            cut = held.find(b"\n")
            if cut < 0:
                at, held = at + len(held), b""
                if not new:
                    return
                continue
            at, held, begun = at + cut + 1, held[cut + 1 :], True
        if length is not None and at > length:
            return
        last = held.find(b"\n", length - at) if length is not None and at + len(held) > length else -1
        if last >= 0:
            yield held[:last].split(b"\n")
            return
        if not new:
            if held:
                yield held.removesuffix(b"\n").split(b"\n")
            return
        cut = held.rfind(b"\n")
        if cut >= 0:
            yield held[:cut].split(b"\n")
            at, held = at + cut + 1, held[cut + 1 :]


def read_frames(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(value, path) of all lines of the zstd files below the paths, as ``read_lines`` gives them.

    Files with a seek table are read by as many tasks as they have splits, others by
    one each. Lines may cross frames and may hold any bytes. Files without lines add
    nothing; files that are not zstd are an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length")
    local = lambda path: "/" + path[5:].lstrip("/") if path.startswith("file:") else path

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                system, path = file_system(local(row["path"]))
                with system.open_input_file(path) as stream:
                    sizes = read_seek_table(stream, row["length"])
                found = [(0, None)] if sizes is None else splits(sizes, split_bytes)
                rows += [(row["path"], at, n) for at, n in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["path", "start", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for row in batch.to_pylist():
                system, path = file_system(local(row["path"]))
                with system.open_input_file(path) as packed:
                    packed.seek(row["start"])
                    stream = zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True)
                    for lines in split_lines(stream, row["start"] == 0, row["length"]):
                        for k in range(0, len(lines), 10_000):
                            values = pa.array(lines[k : k + 10_000], pa.binary())
                            yield pa.RecordBatch.from_arrays([as_text(values), pa.array([row["path"]] * len(values), pa.string())], ["value", "path"])

    tasks = spark.sparkContext.defaultParallelism
    planned = files.repartition(tasks, "path").mapInArrow(plan, "path string, start long, length long")
    return planned.repartition(4 * tasks, "path", "start").mapInArrow(read, "value string, path string")
