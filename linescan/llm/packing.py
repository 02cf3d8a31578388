"""Best-fit packing of token sequences, bulk-synchronous.

Pieces go in bands of length, longest first: a band's pieces are more than half
as long as its longest may be. In a round, the pieces of the band that are left
and the gaps that may hold one are range-sorted together, largest first. A
sweep over each range gives every piece its successor, the smallest gap before
it in this order that no piece between them took; what a range cannot match by
itself is matched between ranges, by rank: the k-th piece left open by the
ranges before it belongs to the k-th gap from their end. Gaps then shrink, and
the next round begins. Where the gaps cannot hold all that is left, so many new
sequences open as the tokens in excess fill. A gap that holds several pieces of
the band in any case takes part as often. All of it are tables: a round writes
its gaps, its matches and the pieces left over; the driver sees a row of counts
for each range. Once what is left of a band and its gaps are a few thousand rows,
however many there were, one range is enough, and its task goes on from round to
round by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import by_bytes, lists
from .tables import keep, table

CAPACITY = 1024
END_ID = 2
#: Where the vocabularies lie: the name of a file that ``public_tokenizers.path`` knows.
VOCABULARY = "byte_bpe_50k"
#: A range holds about so many pieces and gaps at most.
RANGE_ROWS = 2_000_000
#: So many pieces and gaps are worth a range of their own; a band that has no more left is one range until all have a place.
TAIL_ROWS = 30_000

PIECE_FIELDS = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class ByteBpe:
    """The ids that the JSON form of a byte-level BPE gives with ``add_special_tokens=False``.

    The rank form has the same vocabulary and the same merges and is several times
    as fast; a text that its pattern cannot walk through, such as a million blanks
    in a row, is left to the JSON form. A special token's string in a text is that
    token.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken

        self.vocabulary, self._whole = vocabulary, None
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {"<|endoftext|>": 50256}
        self.quick = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @property
    def whole(self):
        """The JSON form."""
        if self._whole is None:
            import os

            import public_tokenizers
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._whole = Tokenizer.from_file(public_tokenizers.path(f"{self.vocabulary}.json"))
        return self._whole

    def encode(self, text: str) -> np.ndarray:
        try:
            if "<|endoftext|>" in text:
                return np.array(self.quick.encode(text, allowed_special="all"), np.uint32)
            return self.quick.encode_to_numpy(text)
        except Exception:  # its pattern gave up
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str, ByteBpe] = {}


def encode_text(text: str, vocabulary: str) -> np.ndarray:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ByteBpe(vocabulary)
    return _ENCODERS[vocabulary].encode(text)


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of pieces: full ones, but for the first, which takes the rest."""
    first = n_tokens % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n_tokens, capacity))]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every text of ``docs`` (doc_id, text).

    A document is its ids and an end id; a null text is empty, so it is the end
    id alone. Repeated rows give repeated pieces. Other columns are ignored.
    Whole texts are encoded, of any length; no documents give no pieces.
    """
    schema = PIECE_FIELDS + (", ids array<int>" if with_ids else "")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            owner, rows, crcs, parts = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode_text(text or "", vocabulary), END_ID).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    owner.append(i)
                    rows.append((k, start, n))
                    crcs.append(zlib.crc32(ids[start : start + n]))
                    if with_ids:
                        parts.append(ids[start : start + n])
            piece, start, length = (np.array(c) for c in zip(*rows))
            columns = [
                batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crcs, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(lists(parts, pa.int32()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenize, schema)


def bands_of(capacity: int) -> list[tuple[int, int]]:
    """(least, greatest) length of each band below the pieces that fill more than half a sequence."""
    out, most = [], capacity // 2
    while most > max(capacity // 32, 1):
        out.append((most // 2 + 1, most))
        most //= 2
    return [*out, (1, most)] if most else out


def successors(size_order: pa.Table) -> pa.Table:
    """Sweep over one range: rows of gaps (piece false) and pieces, largest first, gaps before pieces of their size.

    A gap opens a bracket and a piece closes one. Rows of one level alternate, so
    a gap and the next row of its level, if that is a piece, belong together.
    """
    piece = size_order.column("piece").to_numpy(zero_copy_only=False)
    ids, slots, sizes = (size_order.column(c).to_numpy() for c in ("id", "slot", "size"))
    depth = np.cumsum(np.where(piece, -1, 1))
    level = np.where(piece, depth + 1, depth)
    order = np.argsort(level, kind="stable")
    one, other = order[:-1], order[1:]
    pair = (level[one] == level[other]) & ~piece[one] & piece[other]
    gaps, taken = one[pair], other[pair]
    rest = np.ones(len(ids), bool)
    rest[gaps] = rest[taken] = False
    rest = np.flatnonzero(rest)
    open_piece = piece[rest]
    n = len(gaps)

    def column(matched: np.ndarray, left: np.ndarray, known: np.ndarray, kind: pa.DataType) -> pa.Array:
        mask = np.concatenate([np.zeros(n, bool), ~known])
        return pa.array(np.concatenate([matched, left]), kind, mask=mask)

    return pa.table({
        "seq": column(ids[gaps], ids[rest], ~open_piece, pa.int64()), "slot": column(slots[gaps], slots[rest], ~open_piece, pa.int32()),
        "pid": column(ids[taken], ids[rest], open_piece, pa.int64()), "length": column(sizes[taken], sizes[rest], open_piece, pa.int64()),
        "level": pa.array(np.concatenate([np.zeros(n, np.int64), level[rest]]), mask=np.arange(n + len(rest)) < n),
    })


SWEPT = "part int, seq long, slot int, pid long, length long, level long"


def swept_ranges(slots: DataFrame, left: DataFrame, rows: int) -> DataFrame:
    """Matches (seq, slot, pid, length), and what each range leaves open: gaps without a pid, pieces without a seq."""
    spark = slots.sparkSession
    gaps = slots.select(F.lit(False).alias("piece"), F.col("seq").alias("id"), "slot", "size")
    both = gaps.unionByName(left.select(F.lit(True).alias("piece"), F.col("pid").alias("id"), F.lit(0).alias("slot"), F.col("length").alias("size")))
    n = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // max(TAIL_ROWS, 1))), -(-rows // RANGE_ROWS))
    order = [F.desc("size"), "piece", "id", "slot"]
    ranges = both.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            part = held[0].column("part")[0].as_py()
            for b in successors(pa.Table.from_batches(held)).to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), *b.columns], ["part", *b.schema.names])

    return keep(ranges.mapInArrow(sweep, SWEPT), "sweep")


def between_ranges(swept: DataFrame) -> DataFrame:
    """``swept`` with what was left open matched between ranges: matches (seq, slot, pid, length) and pieces left (no seq)."""
    spark = swept.sparkSession
    depth, starts = 0, []
    nets = swept.where("level IS NOT NULL").groupBy("part").agg(F.sum(F.when(F.col("pid").isNull(), 1).otherwise(-1)).alias("net")).collect()
    for part, net in sorted(nets):  # a row for each range
        starts.append((part, depth))
        depth += net
    base = F.broadcast(spark.createDataFrame(starts, "part int, base long"))
    opened = swept.where("level IS NOT NULL").join(base, "part").withColumn("level", F.col("level") + F.col("base"))
    # At one level the ranges' open gaps and pieces alternate; in a range, its open pieces come first.
    by_level = Window.partitionBy("level").orderBy("part", F.col("seq").isNotNull())
    before = F.struct("seq", "slot")
    paired = opened.withColumn("before", F.lag(before).over(by_level)).where("pid IS NOT NULL")
    paired = paired.select(F.col("before.seq").alias("seq"), F.col("before.slot").alias("slot"), "pid", "length")
    return swept.where("level IS NULL").select("seq", "slot", "pid", "length").unionByName(paired)


def shrunk(gaps: DataFrame, matched: DataFrame, capacity: int, least: int) -> DataFrame:
    """A round's table: gaps as they are now (no pid), matches with their offsets, and pieces left over (no seq).

    Several pieces for one sequence lie there in the order of the slots. ``again``
    marks the gaps that may take another piece: those that took one and still
    have ``least``. A gap that took none is smaller than all that is left.
    """
    none = F.lit(None).cast("long")
    left = matched.where("seq IS NULL").select("seq", none.alias("gap"), "pid", "length", none.alias("offset"), F.lit(False).alias("again"))
    base = gaps.select("seq", "gap", F.lit(-1).alias("slot"), none.alias("pid"), F.lit(0).cast("long").alias("length"))
    hits = matched.where("seq IS NOT NULL").select("seq", none.alias("gap"), "slot", "pid", "length")
    own = Window.partitionBy("seq").orderBy("slot")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap, taken = F.max("gap").over(whole), F.sum("length").over(whole)
    is_gap = F.col("pid").isNull()
    met = base.unionByName(hits).select(
        "seq", F.when(is_gap, gap - taken).alias("gap"), "pid", "length",
        F.when(~is_gap, capacity - gap + F.sum("length").over(upto) - F.col("length")).alias("offset"),
        (is_gap & (taken > 0) & (gap - taken >= least)).alias("again"),
    )
    return keep(met.unionByName(left), "round")


def swept_out(pieces: np.ndarray, gaps: np.ndarray, capacity: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rounds of one range: the sequence and the offset of each of ``pieces`` (lengths), and the gaps as they are then.

    Sequences are counted as in ``gaps``, those that open come behind. A round does what ``pack_band`` does.
    """
    sequence, offset = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    left, usable, gaps = np.arange(len(pieces)), np.arange(len(gaps)), gaps.copy()
    while len(left):
        wanted, room = pieces[left], gaps[usable]
        excess = int(wanted.sum()) - (int(room.sum()) if room.max(initial=0) >= wanted.min() else 0)
        fresh = -(-max(0, excess) // capacity)
        usable = np.append(usable, np.arange(len(gaps), len(gaps) + fresh))
        gaps = np.append(gaps, np.full(fresh, capacity))
        most = wanted.max()
        times = np.clip(gaps[usable] // most, 1, -(-2 * len(left) // len(usable)))
        owner = np.repeat(usable, times)
        slot = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        ids, slots = np.append(owner, left), np.append(slot, np.zeros(len(left), np.int64))
        size, piece = np.append(gaps[owner] - slot * most, wanted), np.arange(len(ids)) >= len(owner)
        order = np.lexsort((slots, ids, piece, -size))
        swept = successors(pa.table({"piece": piece[order], "id": ids[order], "slot": slots[order].astype(np.int32), "size": size[order]}))
        met = swept.filter(pc.and_(swept["seq"].is_valid(), swept["pid"].is_valid())).sort_by([("seq", "ascending"), ("slot", "ascending")])
        to, taken, n = (met[c].to_numpy() for c in ("seq", "pid", "length"))
        filled, first, count = np.unique(to, return_index=True, return_counts=True)
        before = np.cumsum(n) - n  # tokens of the matches before, then of those in the same sequence
        sequence[taken], offset[taken] = to, capacity - gaps[to] + before - np.repeat(before[first], count)
        np.subtract.at(gaps, to, n)
        usable = filled[gaps[filled] >= least]  # a gap that took none is smaller than all that is left
        left = np.setdiff1d(left, taken, assume_unique=True)
    return sequence, offset, gaps


ROUND = "seq long, gap long, pid long, length long, offset long, again boolean"


def tail(left: DataFrame, gaps: DataFrame, capacity: int, least: int, opened: int) -> DataFrame:
    """The table of a last round that places all of ``left``, by one task: for ``TAIL_ROWS`` rows at most."""
    none = F.lit(None).cast("long")
    both = gaps.select("seq", "gap", none.alias("pid"), none.alias("length")).unionByName(left.select(none.alias("seq"), none.alias("gap"), "pid", "length"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        old, pieces = rows.filter(rows["pid"].is_null()).sort_by("seq"), rows.filter(rows["pid"].is_valid()).sort_by("pid")
        at, offset, now = swept_out(pieces["length"].to_numpy(), old["gap"].to_numpy(), capacity, least)
        names = np.append(old["seq"].to_numpy(), -np.arange(opened + 1, opened + 1 + len(now) - len(old)))
        n, m = len(now), len(at)
        out = pa.table({
            "seq": np.append(names, names[at]), "gap": pa.array(np.append(now, np.zeros(m, np.int64)), mask=np.arange(n + m) >= n),
            "pid": pa.concat_arrays([pa.nulls(n, pa.int64()), pieces["pid"].combine_chunks()]), "length": np.append(np.zeros(n, np.int64), pieces["length"].to_numpy()),
            "offset": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(offset)]), "again": np.zeros(n + m, bool),
        })
        yield from out.to_batches(max_chunksize=1 << 16)

    return keep(both.repartition(1).mapInArrow(finish, ROUND), "tail")


def pack_band(left: DataFrame, gaps: DataFrame, counts: tuple[int, int, int], least: int, capacity: int, opened: int) -> tuple[list[DataFrame], int]:
    """The tables of the rounds that place all of ``left``, and the number of sequences opened, those before included.

    ``counts`` are the number, the tokens and the greatest length of ``left``.
    """
    spark = left.sparkSession
    n_left, tokens, most = counts
    rounds = []
    n_gaps, room, widest = gaps.agg(F.count(F.lit(1)), F.coalesce(F.sum("gap"), F.lit(0)), F.coalesce(F.max("gap"), F.lit(0))).first()
    shortest = least
    while n_left:
        if n_left + n_gaps <= TAIL_ROWS:
            rounds.append(tail(left, gaps, capacity, least, opened))
            lowest = rounds[-1].agg(F.min("seq")).first()[0]
            return rounds, max(opened, -lowest)
        # No packing goes without the sequences that the tokens in excess of all gaps fill.
        fresh = -(-max(0, tokens - (room if widest >= shortest else 0)) // capacity)
        if fresh:
            new = spark.range(opened + 1, opened + 1 + fresh).select((-F.col("id")).alias("seq"), F.lit(capacity).cast("long").alias("gap"))
            gaps, opened, n_gaps = gaps.unionByName(new), opened + fresh, n_gaps + fresh
        # A gap surely holds gap / most pieces; the sum of all slots stays near the number of pieces.
        times = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / most), F.lit(-(-2 * n_left // n_gaps)))).cast("int")
        slots = gaps.withColumn("slot", F.explode(F.sequence(F.lit(0), times - 1)))
        slots = slots.select("seq", "slot", (F.col("gap") - F.col("slot") * most).alias("size"))
        now = shrunk(gaps, between_ranges(swept_ranges(slots, left, 3 * n_left + n_gaps)), capacity, least)
        rounds.append(now)
        still = F.when(F.col("seq").isNull(), F.col("length"))
        usable = F.when(F.col("again"), F.col("gap"))
        n_left, tokens, most, shortest, n_gaps, room, widest = now.agg(
            F.count(still), F.sum(still), F.max(still), F.min(still), F.count(usable), F.coalesce(F.sum(usable), F.lit(0)), F.coalesce(F.max(usable), F.lit(0))
        ).first()
        left, gaps = now.where("seq IS NULL").select("pid", "length"), now.where("again").select("seq", "gap")
    return rounds, opened


def best_fit_packing(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length of 1 to ``capacity``, other columns as they come) plus sequence_id and offset.

    Every piece gets a place, repeated rows too; offsets in a sequence run from 0
    without a gap. A column named sequence_id or offset is replaced; others keep
    their values, nulls too. A length that is null or out of range is an error.
    No pieces give no rows. Equal lengths are told apart by an id of the row, so
    which of them goes where may differ between runs; how many sequences there
    are does not follow from it.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    rows = keep(pieces.select(F.monotonically_increasing_id().alias("pid"), F.col("length").cast("long").alias("length"), row), "rows")
    bands = bands_of(capacity)
    band = F.when(2 * F.col("length") > capacity, -1)
    for i, (least, _) in enumerate(bands):
        band = band.when(F.col("length") >= least, i)
    sizes = rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"), F.max("length").alias("most")).collect()
    if any(s.band is None or s.most > capacity for s in sizes):
        raise ValueError(f"lengths must be 1 to {capacity}")
    wide = rows.where(2 * F.col("length") > capacity)  # no two of them share a sequence
    gaps = wide.select(F.col("pid").alias("seq"), (capacity - F.col("length")).alias("gap")).where("gap > 0")
    placed, opened = [], 0
    for s in sorted(s for s in sizes if s.band >= 0):
        least, most = bands[s.band]
        left = rows.where(F.col("length").between(least, most)).select("pid", "length")
        rounds, opened = pack_band(left, gaps.where(F.col("gap") >= least), (s.n, s.tokens, s.most), least, capacity, opened)
        idle = [t.where("pid IS NULL AND gap > 0 AND NOT again") for t in rounds[:-1]] + [rounds[-1].where("pid IS NULL AND gap > 0")]
        gaps = keep(reduce(DataFrame.unionByName, (t.select("seq", "gap") for t in [gaps.where(F.col("gap") < least), *idle])), "gaps")
        placed += [t.where("seq IS NOT NULL AND pid IS NOT NULL").select("pid", "seq", "offset") for t in rounds]
    alone = wide.select("row.*", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not placed:
        return alone
    narrow = rows.where(2 * F.col("length") <= capacity).join(reduce(DataFrame.unionByName, placed), "pid")
    return alone.unionByName(narrow.select("row.*", F.col("seq").alias("sequence_id"), "offset"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return best_fit_packing(token_pieces(table(spark, sf_dir, "documents")))
