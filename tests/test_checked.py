"""Damaged objects are reported once, and cost nothing but their own lines."""

import gzip
import io
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from linescan.sources import checked
from linescan.sources.checked import checked_lines, damage_report, read_checked, sound_lines
from linescan.sources.frames import seek_table

TEXT = b"one\r\n\xff\xfe two\n\nthree\nlast"
LINES = [b"one\r", b"\xff\xfe two", b"", b"three", b"last"]


def split(data, name):
    out = list(checked_lines(io.BytesIO(data), name))
    return [x for part in out if not isinstance(part, str) for x in part], [x for x in out if isinstance(x, str)]


@pytest.mark.parametrize("chunk", [1, 5, 1 << 20])
def test_formats_and_damage(monkeypatch, chunk):
    monkeypatch.setattr(checked, "CHUNK", chunk)
    pack = zstandard.ZstdCompressor().compress
    gz = gzip.compress(TEXT[:9]) + gzip.compress(TEXT[9:])
    zst = pack(TEXT[:9]) + pack(TEXT[9:]) + seek_table([(1, 1), (2, 2)])
    for data, name in ((TEXT, "a.txt"), (gz, "a.gz"), (zst, "a.zst"), (zst, "a.zstd")):
        assert split(data, name) == (LINES, []), name
        assert split(b"", name) == ([], [])
    rng = random.Random(0)
    long = b"".join(b"%032x\n" % rng.getrandbits(128) for _ in range(3000))
    whole = long.split(b"\n")[:-1]
    for data, name in ((gzip.compress(long), "a.gz"), (pack(long), "a.zst")):
        kept, said = split(data[: len(data) // 2], name)
        assert kept == whole[: len(kept)] and said == ["Damaged: cut short"] and len(kept) < 3000
        assert name == "a.zst" or len(kept) > 500
        flipped = data[: len(data) // 3] + bytes(x ^ 0x55 for x in data[len(data) // 3 : len(data) // 3 + 20]) + data[len(data) // 3 + 20 :]
        assert len(split(flipped, name)[1]) <= 1
        assert split(b"foreign text\n", name)[0] == [] and len(split(b"foreign text\n", name)[1]) == 1
        assert split(data + b"rubbish", name)[0] == whole and len(split(data + b"rubbish", name)[1]) == 1


def test_report(spark, tmp_path):
    pack = zstandard.ZstdCompressor().compress
    rng = random.Random(1)
    long = b"".join(b"%032x\n" % rng.getrandbits(128) for _ in range(5000))
    (tmp_path / "a b").mkdir()
    given = {
        "sound.gz": gzip.compress(TEXT), "a b/sound+%.zst": pack(TEXT), "plain": TEXT, "empty": b"", "cut.gz": gzip.compress(long)[:40_000], "cut.zst": pack(long)[:-10], "foreign.zst": b"no zstd\n",
    }
    for name, data in given.items():
        (tmp_path / name).write_bytes(data)
    keys = [*given, "missing.gz", "sound.gz", None]
    catalog = spark.createDataFrame([(k, 1) for k in keys], "key string, size int")
    read = read_checked(spark, f"file://{tmp_path}", catalog).cache()
    report = {r.key: r for r in damage_report(read).collect()}
    assert damage_report(read).count() == 4 and set(report) == {"cut.gz", "cut.zst", "foreign.zst", "missing.gz"}
    assert report["foreign.zst"].lines == report["missing.gz"].lines == 0 and "FileNotFound" in report["missing.gz"].error and report["cut.gz"].error == "Damaged: cut short"
    rows = sound_lines(read).select("key", F.col("value").cast("binary").alias("v")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.key, []).append(bytes(r.v))
    for name in ("sound.gz", "a b/sound+%.zst", "plain"):
        assert got[name] == LINES
    assert "empty" not in got and 0 < report["cut.gz"].lines == len(got["cut.gz"]) < 5000
    assert got["cut.gz"] == long.split(b"\n")[: len(got["cut.gz"])]
    assert damage_report(read_checked(spark, str(tmp_path), catalog.limit(0))).count() == 0
