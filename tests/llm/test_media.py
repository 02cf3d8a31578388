import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linescan.llm import media
from tests.conftest import DATA

RNG = np.random.default_rng(0)


def test_netpbm():
    grey = RNG.integers(0, 256, (3, 5), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    text = b"P2 # a comment\n5 3\n255\n" + b" ".join(b"%d" % v for v in grey.reshape(-1))
    assert (media.decode(text) == grey).all()
    rgb = RNG.integers(0, 256, (2, 3, 3), np.uint8)
    assert (media.decode(b"P6\n3 2\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P3\n3 2\n255\n" + b" ".join(b"%d" % v for v in rgb.reshape(-1))) == rgb).all()
    bits = RNG.integers(0, 2, (4, 10))
    expected = np.where(bits, 0, 255)
    assert (media.decode(b"P1\n10 4\n" + b"\n".join(b"".join(b"%d" % v for v in r) for r in bits)) == expected).all()
    assert (media.decode(b"P4\n10 4\n" + np.packbits(bits.astype(np.uint8), axis=1).tobytes()) == expected).all()
    deep = RNG.integers(0, 60000, (2, 2)).astype(">u2")
    assert (media.decode(b"P5 2 2 65535\n" + deep.tobytes()) == deep).all()
    for bad in (b"P5\n9 9\n255\nx", b"P9\n1 1\n", b"", b"BM"):
        with pytest.raises(ValueError):
            media.decode(bad)


def bmp(rows, bits, palette=b"", height=None):
    body = b"".join(r + b"\0" * (-len(r) % 4) for r in rows)
    at = 54 + len(palette)
    width = {24: len(rows[0]) // 3, 32: len(rows[0]) // 4, 8: len(rows[0])}.get(bits, 5)
    head = struct.pack("<IiiHHIIiiII", 40, width, height or len(rows), 1, bits, 0, 0, 0, 0, len(palette) // 4, 0)
    return b"BM" + struct.pack("<IHHI", at + len(body), 0, 0, at) + head + palette + body


def test_bmp():
    grey = RNG.integers(0, 256, (3, 5), np.uint8)
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    rgb = RNG.integers(0, 256, (3, 5, 3), np.uint8)
    bgr = rgb[:, :, ::-1]
    assert (media.decode(bmp([r.tobytes() for r in bgr[::-1]], 24)) == rgb).all()
    assert (media.decode(bmp([r.tobytes() for r in bgr], 24, height=-3)) == rgb).all()
    with_alpha = np.concatenate([bgr, np.zeros((3, 5, 1), np.uint8)], 2)
    assert (media.decode(bmp([r.tobytes() for r in with_alpha[::-1]], 32)) == rgb).all()
    four = bmp([bytes([0x01, 0x23, 0x40])], 4, b"".join(bytes([i, 0, 0, 0]) for i in range(16)))
    assert (media.decode(four)[0, :, 2] == [0, 1, 2, 3, 4]).all()
    one = bmp([bytes([0b10110000])], 1, bytes([0, 0, 0, 0, 255, 255, 255, 0]))
    assert (media.decode(one) == [[255, 0, 255, 255, 0]]).all()


def slow_resize(image, height, width):
    fine = np.repeat(np.repeat(image.astype(float), height, 0), width, 1)
    return fine.reshape(height, image.shape[0], width, image.shape[1]).mean(axis=(1, 3))


@pytest.mark.parametrize("shape", [(1, 64), (7, 64), (8, 9), (33, 5), (100, 64)])
def test_area_resize(shape, monkeypatch):
    monkeypatch.setattr(media, "BAND_ROWS", 16)
    image = RNG.integers(0, 256, shape, np.uint8)
    assert np.allclose(media.area_resize(image, 8, 9), slow_resize(image, 8, 9))
    colour = np.stack([image, 255 - image, image // 2], axis=2)
    assert np.allclose(media.area_resize(colour, 4, 4)[..., 1], slow_resize(255 - image, 4, 4))


def test_tiles_and_hashes():
    image = np.tile(np.arange(64, dtype=np.uint8), (10, 1))
    assert media.difference_hash(image) == "ff" * 8 and media.difference_hash(image[:, ::-1]) == "00" * 8
    tile = np.load(io.BytesIO(media.npy_tile(image, 16)))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8


def test_edge_rows(spark):
    good = media.encode_pgm(np.zeros((2, 3), np.uint8))
    rows = [(1, bytearray(good), "a"), (1, bytearray(good), "a"), (2, None, "b"), (3, bytearray(b""), "c"), (4, bytearray(b"P5\n9 9\n255\n"), None)]
    df = spark.createDataFrame(rows, "k int, media binary, dhash string")
    out = media.with_media_features(df).orderBy("k").collect()
    assert [r.n_samples for r in out] == [6, 6, None, None, None]
    assert out[0].height == 2 and out[0].dhash == "0" * 16
    assert media.with_media_features(df.where("false")).count() == 0


def test_query_against_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r.doc_id: r for r in media.op3_media_columns(spark, DATA).collect()}
    assert len(got) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.feature == media.difference_hash(media.decode(stored))


def test_empty_and_long_texts(spark):
    texts = [None, "", "x" * 64, "é" * 33, "z" * 3_000_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.monotonically_increasing_id().alias("i"), media.text_as_pgm(F.col("t")).alias("media"))
    got = [r.n_samples for r in media.with_media_features(df).orderBy("i").collect()]
    assert got == [64, 64, 64, 128, 3_000_000]


def test_greatest_values():
    assert media.decode(b"P2\n3 1\n15\n0 5 15").tolist() == [[0, 85, 255]]
    assert media.decode(b"P5\n2 1\n1000\n" + np.array([500, 1000], ">u2").tobytes()).tolist() == [[32768, 65535]]


def test_bad_images_have_null_features(spark):
    huge = b"9" * 30
    bad = [
        b"P2\n1 1\n255\n300", b"P2\n1 1\n255\n-1", b"P2\n1 1\n255\nx", b"P2\n1 1\n255\n" + huge, b"P2\n1 1\n0\n0", b"P2\n1 1\n70000\n1", b"P5\n1 1\n10\n\x0b",
        b"P5\n" + huge + b" " + huge + b"\n255\n", b"P5\n4000000000 4000000000\n255\nx", b"P4\n999999999 999999999\n", b"P1\n99999 99999\n1", b"P5\n0 0\n255\n", b"P5\n" + b"9" * 5000 + b" 1\n255\n",
        b"BM" + b"\xff" * 52, b"BM" + b"\0" * 100, media.encode_bmp(np.zeros((3, 5), np.uint8))[:-1], bytes(range(256)),
    ]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bad)], "k int, media binary")
    assert [r.k for r in media.with_media_features(df).collect() if r.n_samples is not None or r.dhash is not None or r.tile is not None] == []


@pytest.mark.parametrize("shape", [(64, 64), (200, 64), (20, 64), (5, 64), (64, 3), (70, 64, 3)])
def test_tiles_of_parts(shape):
    image = RNG.integers(0, 256, shape, np.uint8)
    got = media.tiles(image, 4, (media.difference_hash(image), media.npy_tile(image, 4)))
    down, across = max(1, round(shape[0] / shape[1])), max(1, round(shape[1] / shape[0]))
    assert [(t["row"], t["col"]) for t in got] == [(r, c) for r in range(down) for c in range(across)]
    planes = [image] if image.ndim == 2 else [image[..., k] for k in range(3)]
    whole = np.stack([slow_resize(p, 4 * down, 4 * across) for p in planes], axis=-1)
    for t in got:
        pixels = np.load(io.BytesIO(t["npy"])).reshape(4, 4, -1)
        want = whole[4 * t["row"] : 4 * t["row"] + 4, 4 * t["col"] : 4 * t["col"] + 4]
        assert pixels.dtype == np.uint8 and np.abs(pixels - want).max() <= 0.5 + 1e-6 and len(t["dhash"]) == 16
    if len(got) == 1:
        assert got[0]["dhash"] == media.difference_hash(image) and got[0]["npy"] == media.npy_tile(image, 4)
