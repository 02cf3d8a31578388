"""Which text filters remove what, in every order that they may be applied in.

One pass over the bytes of a text drives a transducer: a table gives each byte
its kind, another one what to do and the next state for each state and kind. It
counts words, capitals, code points and symbols, and emits the span of every
word, which goes into an open hash table of the text's words. A span counts as
known only if its bytes are those of the word that the table holds, so hashes
that collide change nothing. The rest is a table of counts: documents that fail
the same filters are alike in every order.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import by_bytes
from .tables import table

SPACES, CAPITALS, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", bytes(range(65, 91)), b"#$%&*|"
#: Kinds of bytes; the last is no byte, it stands behind every text.
SPACE, CAPITAL, SYMBOL, CONTINUATION, OTHER, END_OF_TEXT = range(6)
KIND = np.full(256, OTHER, np.uint8)
for _bytes, _kind in ((SPACES, SPACE), (CAPITALS, CAPITAL), (SYMBOLS, SYMBOL), (bytes(range(0x80, 0xC0)), CONTINUATION)):
    KIND[list(_bytes)] = _kind

OUTSIDE, INSIDE = 0, 1
#: What to do at a byte: a word starts here, or ended before it; what is counted.
START, STOP, COUNT_CAPITAL, COUNT_SYMBOL, COUNT_POINT = 1, 2, 4, 8, 16
#: The state behind a byte, which follows from its kind alone.
NEXT = np.array([OUTSIDE if k in (SPACE, END_OF_TEXT) else INSIDE for k in range(6)], np.uint8)
ACTION = np.zeros((2, 6), np.uint8)
for _state, _kind in itertools.product((OUTSIDE, INSIDE), range(6)):
    ACTION[_state, _kind] = (
        START * (_state == OUTSIDE and NEXT[_kind] == INSIDE) + STOP * (_state == INSIDE and NEXT[_kind] == OUTSIDE)
        + COUNT_CAPITAL * (_kind == CAPITAL) + COUNT_SYMBOL * (_kind == SYMBOL) + COUNT_POINT * (_kind not in (CONTINUATION, END_OF_TEXT))
    )

#: Bytes that one step of the pass takes, and the length from which a word is hashed by itself.
STEP = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of BASE and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(max(n, STEP) - 1, b, np.uint64)), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each pair of spans of ``n`` bytes at ``a`` and ``b``: are they equal? ``data`` has 8 bytes more than texts."""
    out = np.ones(len(a), bool)
    windows = np.lib.stride_tricks.sliding_window_view(data, 8)
    for k in range(0, min(int(n.max(initial=0)), 64), 8):
        on = np.flatnonzero(out & (n > k))
        other = windows[a[on] + k] != windows[b[on] + k]
        out[on] = ~(other & (np.arange(8) < (n[on] - k)[:, None])).any(1)
    for i in np.flatnonzero(out & (n > 64)):
        out[i] = np.array_equal(data[a[i] : a[i] + n[i]], data[b[i] : b[i] + n[i]])
    return out


class WordTable:
    """The distinct words of some texts: an open hash table of spans, by text."""

    def __init__(self, data: np.ndarray):
        self.data, self.n = data, 0
        self.slots = np.full(1 << 12, -1, np.int64)
        self.words = [np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64)]  # text, start, length, hash

    def insert(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Is each of the spans new to its text? Of equal spans one is."""
        n, new = self.n, (text, start, length, code)
        if 2 * (n + len(text)) > len(self.slots):
            self._grow(2 * (n + len(text)))
        if len(self.words[0]) < n + len(text):
            self.words = [np.append(w[:n], np.empty(n + 2 * len(text), w.dtype)) for w in self.words]
        for w, x in zip(self.words, new):
            w[n : n + len(text)] = x
        mask = np.uint64(len(self.slots) - 1)
        at = (code & mask).astype(np.int64)
        fresh = np.zeros(len(text), bool)
        pending = np.arange(len(text))
        while len(pending):
            want = pending[self.slots[at[pending]] < 0]
            self.slots[at[want]] = n + want
            held = self.slots[at[pending]]
            fresh[pending[held == n + pending]] = True
            rest, held = pending[held != n + pending], held[held != n + pending]
            alike = np.logical_and.reduce([w[held] == x[rest] for w, x in zip((self.words[0], *self.words[2:]), (text, length, code))])
            known = np.zeros(len(rest), bool)
            known[alike] = _same_bytes(self.data, self.words[1][held[alike]], start[rest[alike]], length[rest[alike]])
            pending = rest[~known]
            at[pending] = (at[pending] + 1) & int(mask)
        self.n = n + int(fresh.sum())
        self.slots[at[fresh]] = np.arange(n, self.n)
        for w, x in zip(self.words, new):  # known words take no room
            w[n : self.n] = x[fresh]
        return fresh

    def _grow(self, least: int) -> None:
        self.slots = np.full(1 << int(least).bit_length(), -1, np.int64)
        mask = len(self.slots) - 1
        at, pending = (self.words[3][: self.n] & np.uint64(mask)).astype(np.int64), np.arange(self.n)
        while len(pending):
            free = pending[self.slots[at[pending]] < 0]
            self.slots[at[free]] = free
            pending = pending[self.slots[at[pending]] != pending]
            at[pending] = (at[pending] + 1) & mask


def pieces_of(data: np.ndarray, start: int, end: int, step: int) -> list[tuple[int, int]]:
    """A text in pieces of at most ``step`` bytes that end behind a space, or one longer word with the space behind it."""
    out = []
    while end - start > step:
        near = np.flatnonzero(KIND[data[start : start + step]] == SPACE)
        if len(near):
            stop = start + int(near[-1]) + 1
        else:
            stop = start + step
            while stop < end and KIND[data[stop]] != SPACE:
                far = np.flatnonzero(KIND[data[stop : min(stop + step, end)]] == SPACE)
                stop = stop + int(far[0]) if len(far) else min(stop + step, end)
            stop = min(stop + 1, end)
        out.append((start, stop))
        start = stop
    return [*out, (start, end)]


#: Columns of ``counts``, in this order.
COUNTS = ["words", "distinct_words", "capitals", "code_points", "symbols"]


def _run(data: np.ndarray, texts: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: WordTable, counts: np.ndarray) -> None:
    """Run the transducer over pieces of ``data`` that lie behind one another; ``counts`` gets what it counts of each text."""
    lengths = ends - starts
    stops = np.cumsum(lengths + 1) - 1  # where each text ends, with a place for that end
    byte = np.ones(int(lengths.sum()) + len(texts), bool)
    byte[stops] = False
    kinds = np.full(len(byte), END_OF_TEXT, np.uint8)
    own = data[starts[0] : ends[-1]]
    kinds[byte] = KIND[own]
    state = np.full(len(kinds), OUTSIDE, np.uint8)
    state[1:] = NEXT[kinds[:-1]]
    actions = ACTION[state, kinds]
    firsts = np.append(0, stops[:-1] + 1)
    for name, bit in (("capitals", COUNT_CAPITAL), ("code_points", COUNT_POINT), ("symbols", COUNT_SYMBOL)):
        np.add.at(counts[COUNTS.index(name)], texts, np.add.reduceat((actions & bit != 0).astype(np.int64), firsts))
    opens = np.flatnonzero(actions & START)
    closes = np.flatnonzero(actions & STOP)
    piece = np.searchsorted(stops, opens)
    a, n = opens - piece, closes - opens  # from here on without the places of ends
    powers, inverse = _powers(len(own))
    sums = np.append(np.uint64(0), np.cumsum((own.astype(np.uint64) + np.uint64(1)) * powers[: len(own)], dtype=np.uint64))
    code = (sums[a + n] - sums[a]) * inverse[a]
    _insert(known, texts[piece], a + starts[0], n, code, counts)


def _insert(known: WordTable, text: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray, counts: np.ndarray) -> None:
    code = (code ^ (length.astype(np.uint64) << np.uint64(40))) * np.uint64(0xD6E8FEB86659FD93) + text.astype(np.uint64) * np.uint64(BASE)
    fresh = known.insert(text, start, length, code ^ (code >> np.uint64(32)))
    texts = counts.shape[1]
    counts[0] += np.bincount(text, minlength=texts)
    counts[1] += np.bincount(text[fresh], minlength=texts)


def _long_word(data: np.ndarray, text: int, start: int, end: int, step: int, known: WordTable, counts: np.ndarray) -> None:
    """The same for a piece that is one word longer than a step."""
    for k in range(start, end, step):
        kinds = np.bincount(KIND[data[k : min(k + step, end)]], minlength=6)
        counts[2:, text] += (kinds[CAPITAL], kinds.sum() - kinds[CONTINUATION], kinds[SYMBOL])
    end -= int(KIND[data[end - 1]] == SPACE)
    code = int.from_bytes(hashlib.sha256(data[start:end]).digest()[:8], "little")
    one = lambda x, kind=np.int64: np.array([x], kind)
    _insert(known, one(text), one(start), one(end - start), one(code, np.uint64), counts)


def counts(texts: pa.Array, step: int = STEP) -> np.ndarray:
    """A row for each of COUNTS, a column for each text; a null text counts as empty."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    edges = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    held = whole.buffers()[2]
    data = np.append(np.frombuffer(held, np.uint8)[edges[0] : edges[-1]] if held else np.empty(0, np.uint8), np.zeros(8, np.uint8))
    edges = edges - edges[0]
    out = np.zeros((len(COUNTS), len(texts)), np.int64)
    known, waiting, size = WordTable(data), [], 0

    def go() -> None:
        if waiting:
            _run(data, *(np.array(c, np.int64) for c in zip(*waiting)), known, out)
        waiting.clear()

    for text in range(len(texts)):
        for a, b in pieces_of(data, int(edges[text]), int(edges[text + 1]), step):
            if size + b - a > step:
                go()
                size = 0
            if b - a > step + 1 or (b - a > step and KIND[data[b - 1]] != SPACE):
                _long_word(data, text, a, b, step, known, out)
            else:
                waiting.append((text, a, b))
                size += b - a
    go()
    return out


def text_counts(docs: DataFrame, *kept: str) -> DataFrame:
    """The kept columns of ``docs`` plus words, distinct_words, capitals, code_points and symbols of the whole
    text, and its SHA-256 as ``digest``.

    Words are the longest runs of bytes other than ASCII white space, told apart by
    case. A null text is an empty one: all counts are 0. Texts may have any length;
    a step of the pass takes 1 MB, or a word that is longer. Rows are judged each by
    itself, so repeated rows give repeated rows, and no documents give none. Columns
    that are not kept are ignored; a kept column named as a count is an error.
    """
    if clash := {*kept} & {*COUNTS, "digest"}:
        raise ValueError(f"columns cannot be kept under the names of counts: {sorted(clash)}")
    fields = [docs.schema[c] for c in kept]
    schema = type(docs.schema)(fields)
    for name in COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("digest", "binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "_text"):
            texts = batch.column("_text")
            digests = [hashlib.sha256(t.as_buffer() if t.is_valid else b"").digest() for t in texts]
            columns = [*(batch.column(c) for c in kept), *(pa.array(c) for c in counts(texts)), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *COUNTS, "digest"])

    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(scan, schema)


LETTERS = "ABCDE"


def failed(least_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5) -> Column:
    """Bits of the filters A to D that a text with these counts fails: few words, few distinct ones, many capitals, a symbol."""
    fails = [
        F.col("words") < least_words, 100 * F.col("distinct_words") < distinct_percent * F.col("words"),
        100 * F.col("capitals") > capital_percent * F.col("code_points"), F.col("symbols") > 0,
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): for each source and set of failed filters, how many documents, and how many
    of them are labelled as of good quality and as toxic.

    ``fails`` has a bit for each of LETTERS; the last is set for a text that a
    smaller doc_id has too, anywhere. Of equal texts the rows of the least doc_id
    pass, all of them if they repeat; a null doc_id is neither smaller nor larger
    and passes. A null source is the empty one. A document has a label if some row
    of ``labels`` gives it; null labels give none.
    """
    scanned = text_counts(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text"), "doc_id", "part")
    rows = scanned.groupBy("digest", "doc_id", "part").agg(F.max(failed()).alias("fails"), F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    marked = rows.join(marks, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    # Rows of one text come down to one for each part and label before they meet.
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    texts = marked.groupBy("digest", "part", "good", "toxic").agg(
        F.max("fails").alias("fails"), F.sum("n").alias("n"), F.min(named).alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    texts = texts.withColumn("passes", F.col("unnamed") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    copies = F.array(F.struct("fails", F.col("passes").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("passes")).alias("n")))
    each = texts.select("part", "good", "toxic", F.explode(copies).alias("c")).where("c.n > 0")
    of = lambda mark: F.coalesce(F.sum(F.when(F.col(mark), F.col("c.n"))), F.lit(0)).alias(mark)
    return each.groupBy("part", F.col("c.fails").alias("fails")).agg(F.sum("c.n").alias("n"), of("good"), of("toxic"))


def interactions(failures: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part and all orders.

    The counts of the contract, from at most 32 rows for each part. A filter that is one
    of k that a document fails removes it in 1/k of the orders. No failures give no rows.
    """
    parts = failures.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    orders = ",".join("".join(p) for p in itertools.permutations(LETTERS))
    rows = parts.select("part", "sets", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    place = [F.locate(c, F.col("filter_order")) for c in LETTERS]
    bits = lambda when: sum((F.when(when(p), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    rows = rows.withColumns({"before": bits(lambda p: p < F.col("step")), "own": bits(lambda p: p == F.col("step"))})
    before, own = F.col("before"), F.col("own")
    meets = lambda s, mask: s["fails"].bitwiseAND(mask) != 0

    def total(chosen, value=lambda s: s["n"]) -> Column:
        return F.aggregate(F.filter("sets", chosen), F.lit(0).cast("long"), lambda a, s: a + value(s))

    removed = lambda s: meets(s, own) & ~meets(s, before)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda s: ~meets(s, own) & ~meets(s, before)).alias("kept"), total(removed).alias("removed"),
        total(lambda s: meets(s, own) & meets(s, before)).alias("redundant"), total(lambda s: s["fails"] == own).alias("unique_fails"),
        total(removed, lambda s: s["good"]).alias("good_lost"), total(removed, lambda s: s["toxic"]).alias("toxic_lost"),
        total(lambda s: meets(s, own), lambda s: s["n"] * F.floor(F.lit(120) / F.bit_count(s["fails"]))).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by source, in all 120 orders."""
    return interactions(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), marks AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN t.doc_id > least THEN 16 ELSE 0 END AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM t LEFT JOIN marks ON marks.doc_id = t.doc_id
), s AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, i AS step, 1 << (ascii(o[i]) - 65) AS own, coalesce(list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(o[j]) - 65))), 0)::BIGINT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
x AS (SELECT *, fails & own <> 0 AS fails_own, fails & before <> 0 AS gone FROM s, steps),
r AS (SELECT part, o AS filter_order, CAST(step AS INT) AS step,
  CAST(coalesce(sum(n) FILTER (NOT fails_own AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails_own AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (fails_own AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (fails_own AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails_own AND NOT gone), 0) AS BIGINT) AS toxic_lost
FROM x GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM r
"""
