"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds all pieces of a vocabulary. One walk over a text finds, at
each position, the pieces that end there, longest first, by output links; each
relaxes the best score of its end from that of its start. A character that no
piece covers becomes its UTF-8 bytes, and so does a mark of a space that stands
in the text itself, so decoding gives the text back.

Nothing is trained. The scores of a BPE file are ranks of merges, whose sum says
nothing; they are read as ranks of frequency by Zipf's law, so a piece of rank r
has the log probability of 1 / (1 + r), and the best path is the likeliest one.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import by_bytes, lists
from .tables import table

#: Name of a SentencePiece model file that ``public_tokenizers.path`` knows.
VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: What a character outside the vocabulary costs beside the worst piece.
UNKNOWN_PENALTY = 10.0
#: Encoded words are kept for re-use up to so many, then forgotten all at once.
CACHED_WORDS = 250_000


class PieceModel:
    """Pieces with scores. Text is encoded as it is, spaces as a visible mark, with one put in front."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks = {i: -model.get_score(i) for i in range(model.get_piece_size()) if is_text_piece(model, i)}
        scores = zipf_scores(ranks) if ranks and max(ranks.values()) >= len(ranks) - 1 else {i: -r for i, r in ranks.items()}
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = {}
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        worst, inner = 0.0, False
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif i in scores:
                score = scores[i]
                self.automaton.add_word(piece, (len(piece), score, i))
                worst = min(worst, score)
                inner |= SPACE in piece.lstrip(SPACE)
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = worst - UNKNOWN_PENALTY
        of_id = {i: b for b, i in self.byte_ids.items()}
        self.spelled = [bytes([of_id[i]]) if i in of_id else p.replace(SPACE, " ").encode("utf-8") for i, p in enumerate(self.pieces)]
        self.inner = inner
        self.mark = np.array([self.byte_ids.get(b, 0) for b in SPACE.encode()], np.int32)
        self.cache: dict[str, bytes] = {}

    def best_path(self, text: str) -> list[int]:
        """Ids of the segmentation of marked text with the highest sum of scores; of equal ones, at each end the longest last piece."""
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        unknown = (1, self.unknown, -1)
        last = [unknown] * (n + 1)
        if self.single.issuperset(text):
            for end, piece in self.automaton.iter(text):
                end += 1
                total = best[end - piece[0]] + piece[1]
                if total > best[end]:
                    best[end], last[end] = total, piece
        else:
            # A character that is no piece by itself may also stand alone, as unknown: behind the pieces that end there.
            done = 0

            def alone(upto: int) -> None:
                for at in range(done + 1, upto + 1):
                    if text[at - 1] not in self.single and best[at - 1] + self.unknown > best[at]:
                        best[at], last[at] = best[at - 1] + self.unknown, unknown

            for end, piece in self.automaton.iter(text):
                alone(end)
                done = max(done, end)
                total = best[end + 1 - piece[0]] + piece[1]
                if total > best[end + 1]:
                    best[end + 1], last[end + 1] = total, piece
            alone(n)
        ids: list[int] = []
        end = n
        while end:
            size, _, i = last[end]
            if i < 0:
                ids.extend(self.byte_ids.get(b, 0) for b in reversed(text[end - 1].encode("utf-8", "surrogatepass")))
            else:
                ids.append(i)
            end -= size
        ids.reverse()
        return ids

    def _word(self, word: str, key: str) -> bytes:
        """int32 ids of a word, its marks in front; kept for the next time."""
        found = array("i", self.best_path(word)).tobytes()
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        if len(word) <= 64:
            self.cache[key] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """int32 ids of a text. No piece goes on into the next word (marks and what follows them),
        so words are encoded one by one, repeated ones once; if some piece does, the text is one word."""
        if not text:
            return np.empty(0, np.int32)
        if SPACE in text:
            # The mark itself is spelled in bytes; what follows it goes on without a space in front.
            parts = [self._marked((SPACE if i == 0 else "") + part.replace(" ", SPACE)) for i, part in enumerate(text.split(SPACE))]
            return np.concatenate([x for part in parts for x in (part, self.mark)][:-1])
        if self.inner or "  " in text or text[0] == " " or text[-1] == " ":
            return self._marked(SPACE + text.replace(" ", SPACE))
        # Single spaces only: a word is known by what stands between them.
        words = text.split(" ")
        found = list(map(self.cache.get, words))
        if None in found:
            found = [self._word(SPACE + w, w) if f is None else f for w, f in zip(words, found)]
        return np.frombuffer(b"".join(found), np.int32)

    def _marked(self, marked: str) -> np.ndarray:
        if self.inner:
            return np.array(self.best_path(marked), np.int32)
        words = _WORD.findall(marked)
        keys = [w[1:] if w[0] == SPACE and w[1:2] not in ("", SPACE) else SPACE + w for w in words]
        found = [self.cache.get(k) or self._word(w, k) for w, k in zip(words, keys)]
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


#: Runs of marks together with what follows them up to the next mark, or what stands in front of the first.
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def is_text_piece(model, i: int) -> bool:
    return not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))


def zipf_scores(ranks: dict[int, float]) -> dict[int, float]:
    """Log probabilities of pieces of rank 0 and up, if frequencies fall as 1 / (1 + rank).

    They are whole numbers of 4096ths: sums are exact, so that equal paths tie in whatever order they are summed.
    """
    total = math.log(sum(1 / (1 + r) for r in ranks.values()))
    return {i: -round((math.log(1 + r) + total) * 4096) / 4096 for i, r in ranks.items()}


_MODELS: dict[str, PieceModel] = {}


def load(vocabulary: str) -> PieceModel:
    """The model of a name that ``public_tokenizers.path`` knows, or of a path; once for each process."""
    if vocabulary not in _MODELS:
        import os

        import public_tokenizers

        _MODELS[vocabulary] = PieceModel(vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary))
    return _MODELS[vocabulary]


def encode_texts(docs: DataFrame, kept: list[str], vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """Columns ``kept`` of ``docs`` plus ids, an array of piece ids.

    A null text has null ids, an empty one none. Rows stay as they are, repeated
    ones too; a column called ids is replaced. Whole texts are encoded; memory
    follows the longest word, not the text. Of equally good paths the one with the
    longest last piece is taken. No rows give none.
    """
    kept = [c for c in kept if c != "ids"]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    wanted = list(dict.fromkeys([*kept, text]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary)
        for batch in by_bytes(batches, text):
            values = batch.column(text).to_pylist()
            ids = lists([model.encode(v or "") for v in values], pa.int32())
            if batch.column(text).null_count:
                ids = pa.array([None if v is None else i for v, i in zip(values, ids.to_pylist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], [*kept, "ids"])

    return docs.select(*(F.col(f"`{c}`") for c in wanted)).mapInArrow(encode, ", ".join([*fields, "ids array<int>"]))


def decode_ids(encoded: DataFrame, kept: list[str], vocabulary: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """Columns ``kept`` of ``encoded`` plus text, what the ids spell; null ids give a null text."""
    kept = [c for c in kept if c != "text"]
    fields = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept]
    wanted = list(dict.fromkeys([*kept, ids]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary)
        for part in by_bytes(batches, ids):
            texts = [model.decode(v.values.to_numpy()) if v.is_valid else None for v in part.column(ids)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    return encoded.select(*(F.col(f"`{c}`") for c in wanted)).mapInArrow(decode, ", ".join([*fields, "text string"]))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text of ``documents``, and the digest of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = encode_texts(docs, ["doc_id"])
    back = decode_ids(encoded, ["doc_id", "ids"])
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"), "ids")
