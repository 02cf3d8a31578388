"""Files of several frames: who reads which lines, and that other readers pass over the table."""

import io
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from linescan.sources import frames
from linescan.sources.frames import FrameWriter, read_frames, read_seek_table, seek_table, split_lines, splits
from linescan.sources.lines import read_lines
from linescan.sources.zstd_lines import read_written, write_lines


def packed(texts, table=True):
    bodies = [zstandard.ZstdCompressor().compress(t) for t in texts]
    return b"".join(bodies) + (seek_table([(len(b), len(t)) for b, t in zip(bodies, texts)]) if table else b"")


def lines_of(text):
    return text.removesuffix(b"\n").split(b"\n") if text else []


@pytest.mark.parametrize("chunk", [1, 3, 1 << 22])
def test_every_line_has_one_owner(monkeypatch, chunk):
    monkeypatch.setattr(frames, "CHUNK", chunk)
    rng = random.Random(0)
    for _ in range(150):
        text = b"".join(rng.choice([b"a", b"bb", b"\n", b"\n", b"\xff", b"long line "]) for _ in range(rng.randint(0, 30)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 6)))
        texts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        data = packed(texts)
        sizes = read_seek_table(io.BytesIO(data), len(data))
        assert sum(p for _, p in sizes) == len(text)
        got = []
        for at, n in splits(sizes, rng.choice([1, 5, 20])):
            stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data[at:]), read_across_frames=True)
            got += [x for part in split_lines(stream, at == 0, n) for x in part]
        assert got == lines_of(text), (text, texts)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
        assert [x for part in split_lines(whole, True, None) for x in part] == lines_of(text)


def test_tables_that_are_none():
    data = packed([b"a\n", b"b\n"])
    find = lambda d: read_seek_table(io.BytesIO(d), len(d))
    assert len(find(data)) == 2 and find(packed([b"a"], table=False)) is None and find(b"") is None and find(b"x" * 40) is None
    assert find(data[1:]) is None and find(b"more" + data) is None and find(data[:-9] + b"\xff" * 4 + data[-5:]) is None


def test_small_files_have_one_frame_and_no_table():
    for most, n in ((100, 1), (10, 10)):
        sink = io.BytesIO()
        writer = FrameWriter(sink, 3, most)
        for i in range(10):
            writer.write(b"line %d\n" % i)
        writer.close()
        data = sink.getvalue()
        assert (len(read_seek_table(io.BytesIO(data), len(data)) or [1])) == n
        assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(b"line %d\n" % i for i in range(10))
    sink = io.BytesIO()
    writer = FrameWriter(sink, 3, 10)
    writer.write(b"ab\ncd\n" + b"e" * 30 + b"\nf\ng\n" + b"h" * 25)
    writer.close()
    sizes = read_seek_table(sink, len(sink.getvalue()))
    assert [p for _, p in sizes] == [6, 31, 4, 25]


def test_many_tasks_read_one_file(spark, tmp_path):
    lines = spark.range(30_000).selectExpr("'p' AS prefix", "concat('line ', sha2(cast(id AS string), 256)) AS value").coalesce(2)
    write_lines(lines, str(tmp_path / "out"), frame_bytes=100_000)
    file = tmp_path / "out" / "p.zst"
    with file.open("rb") as f:
        assert len(read_seek_table(f, file.stat().st_size)) > 10
    found = read_frames(spark, str(tmp_path / "out"), split_bytes=250_000)
    want = {r.value for r in lines.collect()}
    by_task = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 3 and {r.value for r in found.collect()} == want and found.count() == 30_000
    assert {r.value for r in read_lines(spark, str(file)).collect()} == want  # Spark's own reader
    assert read_written(spark, str(tmp_path / "out")).count() == 30_000


def test_files_of_others(spark, tmp_path):
    (tmp_path / "a b.zst").write_bytes(packed([b"x\xff\ny", b"z\n", b"", b"last"]))
    (tmp_path / "plain.zstd").write_bytes(packed([b"p\n", b"q\n"], table=False))
    (tmp_path / "empty.zst").write_bytes(packed([b""]))
    rows = read_frames(spark, str(tmp_path), split_bytes=1).select("path", F.col("value").cast("binary").alias("v")).collect()
    assert sorted((r.path.rsplit("/", 1)[-1].replace("%20", " "), bytes(r.v)) for r in rows) == [("a b.zst", b"last"), ("a b.zst", b"x\xff"), ("a b.zst", b"yz"), ("plain.zstd", b"p"), ("plain.zstd", b"q")]
    assert sorted(bytes(r.v) for r in read_lines(spark, str(tmp_path)).select(F.col("value").cast("binary").alias("v")).collect()) == sorted(bytes(r.v) for r in rows)
