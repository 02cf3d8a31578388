"""Product codes of vectors: four codebooks fitted in exact integers.

Vectors are cut into parts. The parts of each position are sorted along a
Hilbert curve and laid down in flat blocks of neighbours, with the smallest box
around them, their sum and their number. In a round the distances of an entry to
the nearest and to the farthest point of a box bound what it can be to the parts
inside, so a block keeps a short list of entries; where one is left, the block's
sum goes to it without a look at the parts, else an exact kernel compares the
parts with that list. A task adds up what each entry gets, sums of tasks are
added by Spark, and the driver sees the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import keep, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK_ROWS = 256
#: Cells of the Hilbert curve along each direction, as a power of two.
BITS = 4
#: A range of the sort holds about so many parts at most.
RANGE_ROWS = 2_000_000
#: So many sums by label may be broadcast.
BROADCAST_ROWS = 10_000
#: Integers below this are exact in doubles.
EXACT = 2**53
LARGEST = 2**63 - 1


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows of coordinates below 2^bits) on a Hilbert curve, as rows of bytes.

    The transform between axes and the curve's transposed index of Skilling (2004), for all rows at once.
    """
    x = list(cells.T.astype(np.int64))
    width, q = len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(width):
            low = np.int64(q - 1)
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, width):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros(len(cells), np.int64), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    planes = [((v ^ turn) >> b) & 1 for b in range(bits - 1, -1, -1) for v in x]
    return np.packbits(np.stack(planes, 1).astype(np.uint8), axis=1)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of a list column of floats, exact as doubles."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(-1, width)


def _rows_of_bytes(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.itemsize * rows.shape[1]
    ends = np.arange(len(rows) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(rid, vec_id, label, x): rows whose vector is whole, with an id of the row; written once."""
    whole = "embedding IS NOT NULL AND size(embedding) > 0 AND size(embedding) % {parts} = 0 AND NOT exists(embedding, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))"
    rows = vectors.where(whole.format(parts=PARTS)).select("vec_id", "label", F.col("embedding").alias("x"))
    return keep(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "x"), "vectors")


def bounds(kept: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer of each component."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            if batch.num_rows:
                y = integers(batch.column("x"), width)
                low, high = np.minimum(low, y.min(0)), np.maximum(high, y.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(low), pa.array(high)], ["i", "low", "high"])

    found = kept.select("x").mapInArrow(scan, "i int, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    found.sort()
    return np.array([r.low for r in found]), np.array([r.high for r in found])


def storage(largest: float) -> np.dtype:
    """The smallest type that holds all components exactly."""
    return np.dtype(np.int16 if largest < 2**15 else np.int32 if largest < 2**31 else np.float64)


BLOCK_FIELDS = "part int, n int, rids binary, data binary, low binary, high binary, sums binary"


def hilbert_blocks(kept: DataFrame, width: int, low: np.ndarray, high: np.ndarray, n_rows: int) -> DataFrame:
    """A row for each block: the ids and integers of its parts, the box around them and their sums (as doubles)."""
    kind, own = storage(max(abs(low).max(), abs(high).max())), width // PARTS
    span = high - low + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = integers(batch.column("x"), width)
            cells = np.minimum((y - low) / span * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
            for p in range(PARTS):
                at = slice(p * own, (p + 1) * own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(y), p, np.int32)), _rows_of_bytes(hilbert_keys(cells[:, at], BITS)), batch.column("rid"), _rows_of_bytes(y[:, at].astype(kind))],
                    ["part", "key", "rid", "data"],
                )

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # ids and integers of a part that wait for a block
        part = None

        def blocks(least: int) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids, y = (np.concatenate(c) for c in zip(*held))
            whole = len(ids) // BLOCK_ROWS * BLOCK_ROWS if least else len(ids)
            held[:] = [(ids[whole:], y[whole:])] if whole < len(ids) else []
            out = []
            for a in range(0, whole, BLOCK_ROWS):
                points = y[a : min(a + BLOCK_ROWS, whole)].astype(np.float64)
                out.append((part, len(points), ids[a : a + len(points)].tobytes(), y[a : a + len(points)].tobytes(), *(s.tobytes() for s in (points.min(0), points.max(0), points.sum(0)))))
            if out:
                names = [f.split()[0] for f in BLOCK_FIELDS.split(", ")]
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            parts = batch.column("part").to_numpy()
            ids, data = batch.column("rid").to_numpy(), batch.column("data")
            y = np.frombuffer(b"".join(data.to_pylist()), kind).reshape(-1, own)
            for a, b in zip(edges := [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)], edges[1:]):
                if a == b:
                    continue
                if parts[a] != part:
                    yield from blocks(0)
                    part = int(parts[a])
                held.append((ids[a:b], y[a:b]))
            yield from blocks(BLOCK_ROWS)
        yield from blocks(0)

    spark = kept.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-PARTS * n_rows // RANGE_ROWS))
    order = ["part", "key", "rid"]  # with the row's id, so that equal parts go to many ranges
    pieces = kept.select("rid", "x").mapInArrow(cut, "part int, key binary, rid long, data binary")
    return keep(pieces.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lay, BLOCK_FIELDS), "blocks")


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Ascending indexes of the entries that may be nearest to some point of a box.

    An entry whose nearest point of the box is farther than another one's farthest
    point is none of them. Sums may be rounded, so the bounds keep a distance.
    """
    outside = np.maximum(np.maximum(low - entries, entries - high), 0)
    across = np.maximum(entries - low, high - entries)
    nearest, farthest = (outside**2).sum(1), (across**2).sum(1)
    return np.flatnonzero(nearest * (1 - 1e-9) <= farthest.min() * (1 + 1e-9))


def kernel(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest entry, the first of equally near ones, and the squared distance: all in exact integers."""
    largest = max(float(abs(points).max(initial=0)), float(abs(entries).max(initial=0)))
    if 4 * points.shape[1] * largest**2 >= EXACT:  # beyond what doubles hold: Python's integers
        p, e = (np.array([[int(v) for v in row] for row in a], object) for a in (points, entries))
        found = np.array([((x - e) ** 2).sum(1) for x in p], object)
    else:
        found = (points**2).sum(1)[:, None] - 2 * points @ entries.T + (entries**2).sum(1)
    at = found.argmin(1)
    return at, found[np.arange(len(points)), at]


def _points(row: dict, kind: np.dtype, own: int) -> np.ndarray:
    return np.frombuffer(row["data"], kind).reshape(-1, own).astype(np.float64)


def moved(blocks: DataFrame, books: np.ndarray, kind: np.dtype) -> list[list[list[int]]]:
    """The codebooks after a round; ``books`` holds integers as Python has them, by part, entry and position."""
    own, n_entries, exact = len(books[0][0]), len(books[0]), kind != np.float64
    arrays = [np.array(b, np.float64) for b in books]
    number = "long" if exact else "decimal(38,0)"
    fields = f"part int, entry int, n long, sums array<{number}>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, n_entries), np.int64)
        sums = np.zeros((PARTS, n_entries, own), np.int64 if exact else object)
        for batch in batches:
            for row in batch.to_pylist():
                part, entries = row["part"], arrays[row["part"]]
                low, high, total = (np.frombuffer(row[c], np.float64) for c in ("low", "high", "sums"))
                near = shortlist(low, high, entries)
                if len(near) == 1 and exact:
                    counts[part, near[0]] += row["n"]
                    sums[part, near[0]] += total.astype(np.int64)
                    continue
                points = _points(row, kind, own)
                at = near[kernel(points, entries[near])[0]]
                counts[part] += np.bincount(at, minlength=n_entries)
                np.add.at(sums[part], at, points.astype(np.int64) if exact else np.array([[int(v) for v in p] for p in points], object))
        part, entry = np.nonzero(counts)
        totals = sums[part, entry].tolist()
        if not exact:
            from decimal import Decimal

            totals = [[Decimal(v) for v in t] for t in totals]
        kind_of = pa.list_(pa.int64() if exact else pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(totals, kind_of)], ["part", "entry", "n", "sums"]
        )

    found = blocks.mapInArrow(add, fields).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(own)))
    out = [[list(e) for e in b] for b in books]
    for r in found.collect():  # a row for each entry
        out[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(own)]
    return out


def assigned(blocks: DataFrame, books: list, kind: np.dtype) -> DataFrame:
    """(rid, part, entry, error) of every part of every vector."""
    own = len(books[0][0])
    arrays = [np.array(b, np.float64) for b in books]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                entries = arrays[row["part"]]
                near = shortlist(*(np.frombuffer(row[c], np.float64) for c in ("low", "high")), entries)
                at, error = kernel(_points(row, kind, own), entries[near])
                n = row["n"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["rids"], np.int64)), pa.array(np.full(n, row["part"], np.int32)), pa.array(near[at], pa.int32()),
                        pa.array([min(int(e), LARGEST) for e in error], pa.int64()),
                    ], ["rid", "part", "entry", "error"],
                )

    return blocks.mapInArrow(code, "rid long, part int, entry int, error long")


def fit(kept: DataFrame) -> tuple[DataFrame, list, np.dtype] | None:
    """The blocks, the codebooks after the last round (Python integers by part, entry and position) and the blocks' type."""
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "rid").limit(ENTRIES).select("x").collect()  # ENTRIES rows
    if not first:
        return None
    width = len(first[0].x)
    n_rows, odd = kept.agg(F.count(F.lit(1)), F.count_if(F.size("x") != width)).first()
    if odd:
        raise ValueError(f"{odd} vectors have another length than {width}, that of the smallest vec_id")
    low, high = bounds(kept, width)
    largest = max(abs(low).max(), abs(high).max())
    if largest >= 2.0**100:
        raise ValueError("components of 2^90 and more are out of range")
    blocks, kind = hilbert_blocks(kept, width, low, high, n_rows), storage(largest)
    start = np.floor(np.array([r.x for r in first], np.float64) * SCALE)
    books = [[[int(v) for v in row] for row in part] for part in np.split(start, PARTS, axis=1)]
    for _ in range(ROUNDS):
        books = moved(blocks, books, kind)
    return blocks, books, kind


def vector_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``vectors`` (vec_id, embedding, label).

    Rows whose vector is null, is empty, holds a null or non-finite component or has
    a length that four does not divide take no part; among the others one length must
    hold, else it is an error. Repeated rows are rows of their own. A null vec_id comes
    behind all others where the first entries are taken, ties are broken by the row,
    and is null in the result. With fewer rows than entries there are as many entries;
    no rows give none. Other columns are ignored. Components may have any magnitude
    below 2^90; an error beyond the longs is held at their end. Null labels are one label.
    """
    spark, kept = vectors.sparkSession, kept_vectors(vectors)
    found = fit(kept)
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    blocks, books, kind = found
    digest = hashlib.sha256(",".join(str(v) for part in books for entry in part for v in entry).encode()).hexdigest()
    rows = kept.select("rid", F.col("vec_id").cast("long").alias("vec_id"), "label", *(F.lit(None).cast(t).alias(c) for c, t in (("part", "int"), ("entry", "int"), ("error", "long"))))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("vec_id", "long"), ("label", kept.schema["label"].dataType.simpleString()))]
    both = rows.union(assigned(blocks, books, kind).select("rid", *none, "part", "entry", "error"))
    two_digits = lambda p: F.lower(F.lpad(F.hex(F.max(F.when(F.col("part") == p, F.col("entry")))), 2, "0"))
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long")
    coded = both.groupBy("rid").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.concat(*map(two_digits, range(PARTS))).alias("code"), whole.alias("error"))
    coded = keep(coded, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long")
    by_label = keep(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "labels")
    if by_label.count() <= BROADCAST_ROWS:
        by_label = F.broadcast(by_label)
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as four bytes each."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _round_sql(k: int) -> str:
    return f"""
near{k} AS MATERIALIZED (SELECT rid, part, min(d * {ENTRIES} + entry) AS best FROM (
    SELECT p.rid, p.part, c.entry, sum((p.v - c.v) * (p.v - c.v)) AS d FROM pts p JOIN book{k} c ON p.part = c.part AND p.pos = c.pos GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(m.v, c.v) AS v FROM book{k} c LEFT JOIN (
    SELECT p.part, CAST(n.best % {ENTRIES} AS BIGINT) AS entry, p.pos, CAST(floor(sum(p.v) / count(*)) AS BIGINT) AS v
    FROM pts p JOIN near{k} n ON n.rid = p.rid AND n.part = p.part GROUP BY ALL) m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos)"""


ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS y
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), pts AS MATERIALIZED (
  SELECT rid, (i - 1) // (len(y) // {PARTS}) AS part, (i - 1) % (len(y) // {PARTS}) AS pos, y[i] AS v FROM (SELECT rid, y, unnest(range(1, len(y) + 1)) AS i FROM kept)
), book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, v FROM pts WHERE rid <= {ENTRIES}),
{",".join(_round_sql(k) for k in range(ROUNDS + 1))},
codes AS (
  SELECT k.vec_id, k.label, string_agg(lpad(lower(hex(best % {ENTRIES})), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
  FROM near{ROUNDS} n JOIN kept k ON k.rid = n.rid GROUP BY k.rid, k.vec_id, k.label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256 FROM codes
"""
