import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from linescan.llm import packing
from tests.conftest import DATA
from tests.llm.histogram import best_fit_rounds


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def slow_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_rounds_are_as_good_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [1025, 200, 40, 600, 1025, 5][seed], 700)
    matches, opened = best_fit_rounds(dict(Counter(lengths.tolist())), 1024)
    assert sum(m[2] - m[1] for m in matches) == 700
    assert math.ceil(lengths.sum() / 1024) <= opened <= slow_best_fit(lengths.tolist(), 1024) + 1


def test_number_of_matches_does_not_follow_the_data():
    rng = np.random.default_rng(1)
    few, many = ({i: int(rng.integers(1, top)) for i in range(1, 1025)} for top in (1000, 10**10))
    assert len(best_fit_rounds(many, 1024)[0]) < 2 * len(best_fit_rounds(few, 1024)[0])


def test_cut():
    assert packing.cut(1, 1024) == [(0, 1)] and packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]


def test_all_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = packing.op10_best_fit_packing(spark, DATA).collect()
    n = check_places(rows, 1024)
    assert n <= math.ceil(sum(r.length for r in rows) / 1024) + 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(by) == len(docs)
    for d in docs:
        ids = np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by[d.doc_id], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.cut(len(ids), 1024)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (3, "a <|endoftext|> b"), (None, "x"), (4, "word " * 60_000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id int, text string, sequence_id int")
    pieces = packing.token_pieces(docs, with_ids=True)
    out = packing.best_fit_packing(pieces, 1024)
    got = out.collect()
    check_places(got, 1024)
    assert Counter((r.doc_id, r.piece) for r in got)[3, 0] == 2
    special = next(r for r in got if r.doc_id == 3)
    assert 50256 in special.ids and special.ids[-1] == 2
    assert [r.ids for r in got if r.doc_id in (1, 2)] == [[2], [2]]
    assert packing.best_fit_packing(pieces.where("false")).count() == 0
    same = spark.range(5000).selectExpr("1 doc_id", "0 piece", "100L length")  # one row, thousands of times
    assert check_places(packing.best_fit_packing(same, 1000).collect(), 1000) == 500


@pytest.mark.parametrize("seed", range(2))
def test_spark_rounds_are_as_good_as_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [1025, 200][seed], 700).tolist()
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "doc_id long, length int, pid string").repartition(7)
    got = packing.best_fit_packing(df).collect()
    assert sorted((r.doc_id, r.length, r.pid) for r in got) == [(i, n, "x") for i, n in enumerate(lengths)]
    opened = check_places(got, 1024)
    assert math.ceil(sum(lengths) / 1024) <= opened <= best_fit_rounds(dict(Counter(lengths)), 1024)[1] + 2


@pytest.mark.parametrize("seed", range(6))
def test_rounds_of_one_range(seed):
    rng = np.random.default_rng(seed)
    lengths, gaps = rng.integers(1, [513, 200, 40, 300, 2, 5][seed], 700), rng.integers(1, 1024, 90)
    at, offset, now = packing.swept_out(lengths, gaps, 1024, 1)
    start = np.append(1024 - gaps, np.zeros(len(now) - 90, np.int64))
    check_places([Row(sequence_id=s, offset=0, length=n) for s, n in enumerate(start.tolist()) if n] + [Row(sequence_id=s, offset=o, length=n) for s, o, n in zip(at.tolist(), offset.tolist(), lengths.tolist())], 1024)
    assert (start + np.bincount(at, lengths, len(now)).astype(int) == 1024 - now).all()
    assert len(now) - 90 <= max(0, math.ceil((lengths.sum() - gaps.sum()) / 1024)) + 1


@pytest.mark.parametrize("few", [0, 150])
def test_a_band_ends_in_one_range(spark, monkeypatch, few):
    """Rounds over many ranges, those that end in one range, and one range alone place as well."""
    lengths = np.random.default_rng(3).integers(1, 700, 900).tolist()
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length int").repartition(7)
    tables = Counter()
    keep = packing.keep
    monkeypatch.setattr(packing, "keep", lambda df, label: tables.update([label]) or keep(df, label))
    opened = {}
    for rows in (few, 10_000):
        monkeypatch.setattr(packing, "TAIL_ROWS", rows)
        tables.clear()
        got = packing.best_fit_packing(df).collect()
        assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
        opened[rows] = check_places(got, 1024)
        assert (tables["sweep"] > 0) == (rows == few) and (tables["tail"] > 0) == (rows > 0)
    assert tables["tail"] == 5 and max(opened.values()) <= min(opened.values()) + 1  # one table for each band


def test_few_tables_for_few_documents(spark, monkeypatch):
    """A round of a few hundred pieces is no job of its own."""
    tables, keep = [], packing.keep
    monkeypatch.setattr(packing, "keep", lambda df, label: tables.append(label) or keep(df, label))
    assert packing.op10_best_fit_packing(spark, DATA).count() > 300
    assert len(tables) <= 11


def test_sweeps_within_and_between_ranges(spark, monkeypatch):
    """However the ranges lie, each piece takes the smallest gap before it that is free."""
    rng = np.random.default_rng(7)
    for ranges in (1, 5, 40):
        gaps, wanted = rng.integers(1, 60, 90).tolist(), rng.integers(1, 60, 110).tolist()
        slots = spark.createDataFrame([(i, 0, g) for i, g in enumerate(gaps)], "seq long, slot int, size long")
        left = spark.createDataFrame(list(enumerate(wanted)), "pid long, length long")
        monkeypatch.setattr(packing, "RANGE_ROWS", 200 // ranges)
        out = packing.between_ranges(packing.swept_ranges(slots, left, 200)).collect()
        free, missed, total = sorted(gaps), 0, 0
        for n in sorted(wanted, reverse=True):
            fits = [g for g in free if g >= n]
            missed += not fits
            if fits:
                free.remove(fits[0])
                total += fits[0]
        pairs = [(gaps[r.seq], wanted[r.pid]) for r in out if r.seq is not None]
        assert len(out) == 110 and {r.pid for r in out} == set(range(110)) and all(g >= n for g, n in pairs)
        assert len({r.seq for r in out if r.seq is not None}) == len(pairs) and sum(r.seq is None for r in out) == missed and sum(g for g, _ in pairs) == total


def test_odd_lengths(spark):
    for bad in (None, 0, 1001):
        with pytest.raises(ValueError, match="lengths"):
            packing.best_fit_packing(spark.createDataFrame([(1, 5), (2, bad)], "doc_id int, length int"), 1000)
    full = spark.range(30).selectExpr("id doc_id", "10L length")
    assert check_places(packing.best_fit_packing(full, 10).collect(), 10) == 30
    ones = spark.range(300).selectExpr("id doc_id", "1L length")
    assert check_places(packing.best_fit_packing(ones, 100).collect(), 100) == 3 and check_places(packing.best_fit_packing(ones, 1).collect(), 1) == 300


def test_both_forms_of_the_vocabulary_agree():
    import json
    import random

    import public_tokenizers

    coder = packing.ByteBpe()
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        model = json.load(f)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token != "<|endoftext|>"}
    assert ranks == coder.quick._mergeable_ranks
    merged = [ranks[bytes(byte_of[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
    assert merged == sorted(merged)  # so the least rank is the earliest merge
    rng = random.Random(1)
    bits = ["the", " ", "  ", "\n", "\t", "\r\n", "'ll", "é", "日本", "😀", "\u00a0", "\u3000", "\u200b", "12", "_", "<|endoftext|>", "\x00", "A", "."]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))
        assert coder.encode(text).tolist() == coder.whole.encode(text, add_special_tokens=False).ids, text


def test_texts_that_the_quick_form_cannot_take(spark):
    coder = packing.ByteBpe()
    for text in (" " * 2_000_000, "a" + "\n" * 1_200_000 + "b", "x" * 300_000):
        assert (coder.encode(text) == np.array(coder.whole.encode(text, add_special_tokens=False).ids)).all()
    rows = packing.best_fit_packing(packing.token_pieces(spark.createDataFrame([(1, " " * 2_000_000), (2, "a")], "doc_id int, text string"))).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == len(coder.whole.encode(" " * 2_000_000, add_special_tokens=False).ids) + 1
