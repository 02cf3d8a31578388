"""Media columns: Netpbm and BMP images decoded, area-resized, and kept as NPY tiles.

Images are decoded to numpy arrays; the resize averages exact areas read off an
integral image; each tile is an NPY file in a binary column beside a 64-bit
difference hash. All work is per row, so there is no shuffle.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import by_bytes
from .tables import table

BAND_ROWS = 1 << 14
SAMPLE_WIDTH = 64

_HEADER = re.compile(rb"P([1-6])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 2)
_MAXVAL = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (rows, columns) or (rows, columns, 3); bitmaps as 0 and 255.

    Samples are stretched to 8 bits, or to 16 if their greatest value is above
    255; one above the greatest value is an error, as is a header that asks for
    more samples than there are bytes.
    """
    if not (head := _HEADER.match(data)):
        raise ValueError("not a Netpbm image")
    kind, width, height = (int(g) for g in head.groups())
    at, most = head.end(), 1
    if kind not in (1, 4):
        if not (m := _MAXVAL.match(data, at)):
            raise ValueError("no maximal value in a Netpbm image")
        most, at = int(m[1]), m.end()
        if not 1 <= most <= 65535:
            raise ValueError("the maximal value of a Netpbm image is out of range")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if n > 8 * len(data):
        raise ValueError("a Netpbm image is cut short")
    if kind == 1:
        bits = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:]), np.uint8)[:n]
        pixels = np.where(bits == ord("1"), 0, 255).astype(np.uint8)
    elif kind == 4:
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        pixels = np.where(np.unpackbits(packed, axis=1)[:, :width], 0, 255).astype(np.uint8)
    elif kind in (2, 3):
        pixels = np.array([int(v) for v in re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n]], object)
    else:
        pixels = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)  # whatever blank follows
    if pixels.size != n:
        raise ValueError("a Netpbm image is cut short")
    if kind not in (1, 4):
        if n and not 0 <= int(pixels.min()) <= int(pixels.max()) <= most:
            raise ValueError("a sample of a Netpbm image is out of range")
        top = 65535 if most > 255 else 255
        pixels = pixels.astype(np.uint16 if most > 255 else np.uint8)
        if most != top:
            pixels = np.rint(pixels * (top / most)).astype(pixels.dtype)
    return pixels.reshape((height, width) if channels == 1 else (height, width, channels))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; grey palettes give (rows, columns)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    (offset,) = struct.unpack_from("<I", data, 10)
    head, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing != 0 or bits not in (1, 4, 8, 24, 32):
        raise ValueError("only uncompressed BMP images are read")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if width < 0 or stride * rows > len(data):
        raise ValueError("a BMP image is cut short")
    raw = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if bits >= 24:
        step = bits // 8
        return raw[:, : width * step].reshape(rows, width, step)[:, :, 2::-1]
    if bits == 8:
        index = raw[:, :width]
    else:
        split = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
        index = (split @ (1 << np.arange(bits - 1, -1, -1)))[:, :width]
    (used,) = struct.unpack_from("<I", data, 46)
    palette = np.frombuffer(data, np.uint8, (used or 1 << bits) * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    grey = bool((palette == palette[:, :1]).all())
    return palette[index][..., 0] if grey else palette[index]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette, bottom row first."""
    rows, width = samples.shape
    stride = (width + 3) // 4 * 4
    body = np.zeros((rows, stride), np.uint8)
    body[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    at = 54 + 1024
    head = b"BM" + struct.pack("<IHHI", at + body.size, 0, 0, at)
    head += struct.pack("<IiiHHIIiiII", 40, width, rows, 1, 8, 0, body.size, 0, 0, 256, 0)
    return head + palette.tobytes() + body.tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each output pixel covers, as float64.

    The integral image is needed only at the edges of output rows, so it is
    summed band by band: memory follows the band, not the image.
    """
    rows, columns = image.shape[:2]
    edges = np.arange(height + 1) * rows / height
    whole = np.minimum(edges.astype(np.int64), rows - 1)
    part = edges - whole
    at_edge = np.empty((height + 1, *image.shape[1:]), np.float64)
    above = np.zeros(image.shape[1:], np.int64)
    for top in range(0, rows, BAND_ROWS):
        band = image[top : top + BAND_ROWS]
        sums = np.cumsum(band, axis=0, dtype=np.int64)
        for i in np.flatnonzero((whole >= top) & (whole < top + len(band))):
            k = whole[i] - top
            at_edge[i] = above + (sums[k - 1] if k else 0) + part[i] * band[k]
        above += sums[-1]
    integral = np.zeros((height + 1, columns + 1, *image.shape[2:]))
    np.cumsum(at_edge, axis=1, out=integral[:, 1:])
    edges = np.arange(width + 1) * columns / width
    whole = np.minimum(edges.astype(np.int64), columns - 1)
    part = (edges - whole).reshape(1, -1, *[1] * (image.ndim - 2))
    corners = integral[:, whole] + part * (integral[:, whole + 1] - integral[:, whole])
    return np.diff(np.diff(corners, axis=0), axis=1) * (height * width / (rows * columns))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: is each pixel of an 8 x 9 reduction darker than its right neighbour?"""
    small = area_resize(image, 8, 9)
    small = grey(small)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def rounded(image: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Means of an image's samples as samples of its own depth."""
    top = 65535 if image.dtype.itemsize == 2 else 255
    return np.clip(np.rint(means), 0, top).astype(np.uint16 if top > 255 else np.uint8)


def npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(pixels), allow_pickle=False)
    return out.getvalue()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """The whole image as one tile."""
    return npy(rounded(image, area_resize(image, side, side)))


def tiles(image: np.ndarray, side: int, whole: tuple[str, bytes]) -> list[dict]:
    """The image cut into about square parts, each an NPY tile of ``side`` by ``side`` with its own difference hash.

    Tiles come by row, then column. One resize makes all of them; if the image is
    about square itself, ``whole``, its hash and tile, are those of the one part.
    """
    height, width = image.shape[:2]
    down, across = max(1, round(height / width)), max(1, round(width / height))
    if down == across == 1:
        return [{"row": 0, "col": 0, "dhash": whole[0], "npy": whole[1]}]
    pixels = rounded(image, area_resize(image, down * side, across * side))
    small = grey(area_resize(image, down * 8, across * 9))
    out = []
    for r in range(down):
        for c in range(across):
            part = small[r * 8 : r * 8 + 8, c * 9 : c * 9 + 9]
            bits = np.packbits(part[:, :-1] < part[:, 1:]).tobytes().hex()
            out.append({"row": r, "col": c, "dhash": bits, "npy": npy(pixels[r * side : (r + 1) * side, c * side : (c + 1) * side])})
    return out


MEDIA_FIELDS = (
    "height int, width int, channels int, n_samples bigint, samples_sha256 string, tail_crc32 bigint, "
    "dhash string, tile binary, tiles array<struct<row:int,col:int,dhash:string,npy:binary>>"
)
_TILE = pa.struct([("row", pa.int32()), ("col", pa.int32()), ("dhash", pa.string()), ("npy", pa.binary())])
_ARROW = [
    ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("n_samples", pa.int64()),
    ("samples_sha256", pa.string()), ("tail_crc32", pa.int64()), ("dhash", pa.string()), ("tile", pa.binary()),
    ("tiles", pa.list_(_TILE)),
]


def describe(data: bytes | None, side: int) -> tuple:
    """What is read back from one stored image; all null if it is null, empty or unreadable."""
    try:
        image = decode(data or b"")
    except (ValueError, struct.error, IndexError, OverflowError):
        return (None,) * len(_ARROW)
    if not image.size:
        return (None,) * len(_ARROW)
    raw = np.ascontiguousarray(image)
    flat = memoryview(raw.reshape(-1).view(np.uint8))
    whole = difference_hash(image), npy_tile(image, side)
    return (
        *image.shape[:2], 1 if image.ndim == 2 else image.shape[2], image.size, hashlib.sha256(flat).hexdigest(),
        zlib.crc32(flat[-64:]), *whole, tiles(image, side, whole),
    )


def with_media_features(df: DataFrame, media: str = "media", tile_side: int = 16) -> DataFrame:
    """``df`` plus what its images hold: size, sample digests, difference hash, NPY tile, and the tiles of its parts.

    Rows are kept as they are, repeated ones too. A null, empty or unreadable
    image has null features. Columns of ``df`` that carry a name of
    ``MEDIA_FIELDS`` are replaced. The image column itself is not returned.
    """
    made = {name for name, _ in _ARROW}
    kept = [c for c in df.columns if c not in made and c != media]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), MEDIA_FIELDS])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, media, 4 << 20):
            found = list(zip(*(describe(v.as_py(), tile_side) for v in batch.column(media))))
            columns = [pa.array(v, kind) for v, (_, kind) in zip(found, _ARROW)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *(n for n, _ in _ARROW)])

    return df.select(*(F.col(f"`{c}`") for c in kept), media).mapInArrow(features, schema)


def text_as_pgm(text: Column) -> Column:
    """A text's UTF-8 bytes, zero-padded to whole rows, as the samples of a binary PGM."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    rows = F.greatest(F.lit(1), F.ceil(n / SAMPLE_WIDTH).cast("long"))
    head = F.concat(F.lit(f"P5\n{SAMPLE_WIDTH} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    zeros = F.unhex(F.lit("00" * SAMPLE_WIDTH))
    return F.concat(head, raw, F.substring(zeros, F.lit(1), (rows * SAMPLE_WIDTH - n).cast("int")))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a PGM image, read back and described."""
    stored = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        text_as_pgm(F.col("text")).alias("media"),
    )
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return with_media_features(stored).select(
        "doc_id", "n_bytes", F.col("n_samples").alias("payload_bytes"), F.col("samples_sha256").alias("payload_sha256"),
        "tail_crc32", "media_bytes", "media_sha256", F.col("dhash").alias("feature"), "height", "width", "tile", "tiles",
    )
