import random

import numpy as np
import pytest

from linescan.llm import pieces
from tests.conftest import DATA


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    """The library reading the same pieces and scores as a unigram model, whose encoding is the best path."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path(pieces.VOCABULARY), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    scores = pieces.zipf_scores({i: -p.score for i, p in enumerate(proto.pieces) if p.type == 1})
    for i, p in enumerate(proto.pieces):
        p.score = scores.get(i, p.score)
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


TABLE = {}  # the vocabulary of the one model that is tested


def slow(model, marked):
    if not TABLE:
        TABLE.update({p: (n, s, i) for p, (n, s, i) in model.automaton.items()})
    table = TABLE
    best = {0: (0.0, [])}
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - 40), end):
            found = table.get(marked[start:end])
            if found is None and end - start == 1:
                score, ids = model.unknown, [model.byte_ids[b] for b in marked[start:end].encode()]
            elif found is None:
                continue
            else:
                score, ids = found[1], [found[2]]
            total = best[start][0] + score
            if end not in best or total > best[end][0]:
                best[end] = (total, best[start][1] + ids)
    return best[len(marked)][1]


ALPHABET = ["the", "a", "b", " ", "  ", "\n", "\t", "😀", "é", "日", "ing", "́", ".", "A"]


def test_brute_force_and_round_trip(model):
    rng = random.Random(0)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        ids = model.encode(text)
        assert ids.tolist() == (slow(model, "▁" + text.replace(" ", "▁")) if text else []), text
        assert model.decode(ids) == text


def test_like_the_library(spark, model, library):
    """The library's lattice, word by word: over long texts its sums, in 32-bit floats, lose small scores beside large ones."""
    words = {w for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() for w in (r.text or "").split()}
    assert len(words) > 5000
    assert [w for w in sorted(words)[:8000] if model.encode(w).tolist() != library.nbest_encode_as_ids(w, 2)[0]] == []


def test_cache_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 50)
    model.cache.clear()
    text = " ".join(f"w{i}" for i in range(500))
    assert model.decode(model.encode(text)) == text and len(model.cache) <= 50


def test_columns(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a  b\n", 0), (3, "a  b\n", 0), (None, "x", 0), (4, "word " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids int")
    encoded = pieces.encode_texts(df, ["doc_id", "ids"])
    back = pieces.decode_ids(encoded, ["doc_id"]).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in back) == sorted(((a or 0), b or "") for a, b, _ in rows)
    assert [r.text for r in back if r.doc_id == 1] == [None] and [r.text for r in back if r.doc_id == 2] == [""]
    assert encoded.where("false").count() == 0 and pieces.encode_texts(df.where("false"), ["doc_id"]).count() == 0


def test_query(spark):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = pieces.op4_sentencepiece(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() and r.n_pieces == len(r.ids)
        assert np.array(r.ids).max() < 32_000


def test_as_few_pieces_as_the_library(spark, model):
    import public_tokenizers
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.VOCABULARY))
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    ours, theirs = (sum(len(f(t)) for t in texts) for f in (model.encode, plain.encode))
    assert abs(ours / theirs - 1) < 0.1
    assert len(model.encode("The quick brown fox jumps over internationalization lazily.")) <= len(plain.encode("The quick brown fox jumps over internationalization lazily."))


def test_marks_in_the_text(model):
    for text in ("a▁b", "▁", "▁▁", " ▁", "▁ ", "a ▁ b", "▁a", "a▁", "  ▁x▁▁ y ", "▁word ▁word", "\n▁é▁😀"):
        assert model.decode(model.encode(text)) == text, text
    assert model.encode("a▁b").tolist() != model.encode("a b").tolist()


def test_every_code_point_comes_back(model):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 4096):
        block = chars[at : at + 4096]
        for text in ("".join(block), " ".join(block)):
            assert model.decode(model.encode(text)) == text
