import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from linescan.llm import filter_audit

DOCS = "doc_id long, text string, source string, lang string, words string"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


@pytest.mark.parametrize("step", [1 << 20, 16, 7])
def test_transducer(step):
    rng = random.Random(0)
    parts = ["a", "B", "é", "日", "😀", " ", "\n", "\x0b", "\xa0", "#", "|", "aaaaaaaaa", "x" * 30, "the ", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 80, 300]))) for _ in range(300)]
    texts += ["x" * 200 + " " + "x" * 200 + " " + "y" * 200, None, "", " ", "A" * 100]
    assert filter_audit.counts(pa.array(texts, pa.string()), step).T.tolist() == [plain_counts(t or "") for t in texts]
    sliced = pa.array(texts, pa.string()).slice(7, 50)
    assert filter_audit.counts(sliced, step).T.tolist() == [plain_counts(t or "") for t in texts[7:57]]


def test_words_are_told_apart_by_their_bytes():
    """With all hashes alike, the table compares bytes, of short words and long ones."""
    texts = [" ".join(f"w{i % 7}" + "z" * (i % 3 * 50) for i in range(60)), "w1 w2 w1"]
    data = np.frombuffer("\x00".join(texts).encode() + bytes(8), np.uint8)
    table = filter_audit.WordTable(data)
    spans = [(k, m.start() + k * (len(texts[0]) + 1), m.end() - m.start()) for k, t in enumerate(texts) for m in re.finditer(r"\S+", t)]
    text, start, length = (np.array(c) for c in zip(*spans))
    fresh = [table.insert(text[i : i + 20], start[i : i + 20], length[i : i + 20], np.zeros(len(text[i : i + 20]), np.uint64)) for i in range(0, len(text), 20)]
    new = text[np.concatenate(fresh)]
    assert [int((new == k).sum()) for k in (0, 1)] == [len(set(t.split())) for t in texts]


def test_endless_words_and_texts():
    text = "ab " * 700_000 + "é" * 1_500_000 + " C# " + "é" * 1_500_000
    assert filter_audit.counts(pa.array([text, "ab ab"])).T.tolist() == [plain_counts(text), [2, 1, 0, 5, 0]]


def brute(docs, labels):
    """The contract, document by document and order by order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for doc_id, text, source in docs:
        t = text or ""
        words, distinct, capitals, points, symbols = plain_counts(t)
        copy = doc_id is not None and any(o is not None and o < doc_id and (u or "") == t for o, u, _ in docs)
        fails = {"A": words < 50, "B": 100 * distinct < 65 * words, "C": 100 * capitals > 5 * points, "D": symbols > 0, "E": copy}
        rows.append((source or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        removed_in = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = set(order[:k])
                removed = [r for r in own if f in r[0] and not r[0] & gone]
                removed_in[f] += len(removed)
                out[part, "".join(order), k + 1] = [
                    sum(not r[0] & {*gone, f} for r in own), len(removed), sum(f in r[0] and bool(r[0] & gone) for r in own),
                    sum(r[0] == {f} for r in own), sum(r[1] for r in removed), sum(r[2] for r in removed),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_in[order[step - 1]])
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = [" ".join(rng.choice(["the", "of", "Word", "x#", f"w{rng.randrange(99)}"][: rng.choice([2, 3, 5])]) for _ in range(rng.choice([3, 60, 200]))) for _ in range(15)]
    docs = [(i, rng.choice([*pool, "", None, " ".join(f"w{j}" for j in range(60))]), rng.choice(["a", "b", None, ""])) for i in range(120)]
    docs += [(None, pool[0], "a"), (None, pool[0], "a"), (3, pool[1], "b"), (3, pool[1], "b"), docs[5], docs[5]]  # null and repeated ids
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, "en", "clash") for d in docs], DOCS)
    marks = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, text string")
    rows = filter_audit.interactions(filter_audit.failures(frame, marks)).collect()
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in rows}
    assert len(rows) == len(got) == 3 * 600 and got == brute(docs, labels)


def test_counts_columns(spark):
    frame = spark.createDataFrame([(1, "A b", "s", "en", "x"), (1, "A b", "s", "en", "x"), (None, None, None, None, None)], DOCS)
    rows = [tuple(r) for r in filter_audit.text_counts(frame, "doc_id", "lang").collect()]
    assert sorted(rows, key=str) == sorted([(1, "en", 2, 2, 1, 3, 0, hashlib.sha256(b"A b").digest())] * 2 + [(None, None, 0, 0, 0, 0, 0, hashlib.sha256(b"").digest())], key=str)
    with pytest.raises(ValueError, match="words"):
        filter_audit.text_counts(frame, "words")
    empty = spark.createDataFrame([], DOCS)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(filter_audit.failures(empty, marks)).count() == 0
    some = filter_audit.interactions(filter_audit.failures(frame, marks)).where("step = 1 AND filter_order = 'ABCDE'").collect()
    assert {(r.part, r.kept, r.removed, r.good_lost) for r in some} == {("s", 0, 2, 0), ("", 0, 1, 0)}
