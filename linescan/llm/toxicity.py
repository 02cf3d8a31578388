"""Toxicity of texts: the windowed recurrent scorer of ``gru``, trained and applied on Spark.

The network is trained on the driver on a bounded sample of labelled documents;
tasks score all overlapping windows of every text. A document's score comes from
its highest window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .batches import by_bytes
from .tables import table

WINDOW, STRIDE = 32, 16
#: The network is trained on so many clean and toxic documents at most, of so many characters at most each.
SAMPLE, SAMPLE_CHARS = (2000, 800), 20_000
#: Words that occur this often in the sample get an embedding, so many at most.
LEAST_COUNT, MOST_WORDS = 3, 20_000
#: Rounds over the windows: ten, or as many more as make so many steps.
EPOCHS, BATCH, LEAST_STEPS = 8, 256, 300
#: In this share of the rounds the windows of a document are drawn, before the network is fit to choose them.
WARM_SHARE = 1 / 3
#: What a document that the network was trained on weighs in the calibration, beside one that was set aside.
TRAINED_WEIGHT = 0.3
THRESHOLD = 0.7


def words_of(text: str | None) -> list[str]:
    """Lower-case words, split at white space, without the punctuation around them."""
    stripped = (w.strip(".,;:!?\"'()[]{}<>*#%$&-_|/\\") for w in (text or "").lower().split())
    return [w for w in stripped if w]


def window_starts(n: int) -> np.ndarray:
    """Starts of all windows over n words; the last one reaches the end."""
    return np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE)


def windows_over(ids: np.ndarray) -> np.ndarray:
    """Windows of one document's word places, -1 behind its end."""
    starts = window_starts(len(ids))
    padded = np.concatenate([ids, np.full(WINDOW + STRIDE, -1, ids.dtype)])
    return padded[starts[:, None] + np.arange(WINDOW)]


def window_logits(parameters: dict[str, np.ndarray], inputs: np.ndarray, windows: np.ndarray, most: int = 2048) -> np.ndarray:
    return np.concatenate([gru.forward(parameters, inputs, windows[a : a + most]) for a in range(0, len(windows), most)])


@dataclass
class ToxicityModel:
    parameters: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    slope: float = 1.0
    shift: float = 0.0

    def inputs(self, words: list[str]) -> np.ndarray:
        ids = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        return gru.word_inputs(self.parameters, ids, *gru.char_ngrams(words))

    def best_logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest window's logit of each whole text; that of no evidence, ``-shift / slope`` less 8, without words."""
        place: dict[str, int] = {}
        docs = [np.array([place.setdefault(w, len(place)) for w in words_of(t)], np.int64) for t in texts]
        none = (-8.0 - self.shift) / self.slope
        best = np.full(len(texts), none)
        if not place:
            return best
        inputs = self.inputs(list(place))
        some = [i for i, d in enumerate(docs) if len(d)]
        owner = np.repeat(some, [len(window_starts(len(docs[i]))) for i in some])
        windows = np.concatenate([windows_over(docs[i]) for i in some])
        logits = window_logits(self.parameters, inputs, windows)
        best[some] = -np.inf
        np.maximum.at(best, owner, logits)
        return best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return gru.sigmoid(self.slope * self.best_logits(texts) + self.shift)


def sample_texts(docs: DataFrame, labels: DataFrame, sample: tuple[int, int]) -> tuple[list[tuple[str, int]], float]:
    """(text, toxic) of a bounded sample, and the share of toxic ones among all labels.

    Of each class the labelled documents with the least hashes are taken. A
    document with two labels has the higher one, of a doc_id with several texts the
    least text is taken. Documents are found by a join with the few sampled ids;
    texts beyond SAMPLE_CHARS are not sampled.
    """
    once = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = once.agg(F.avg("toxic")).first()[0]
    # Half as many again, as some documents may be gone or too long.
    few = [once.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n + n // 2) for kind, n in enumerate(sample)]
    texts = docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_CHARS)
    found = texts.join(F.broadcast(few[0].union(few[1])), "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("code"), "doc_id")
    rows = found.groupBy("doc_id", "code", "toxic").agg(F.min("text").alias("text")).collect()
    out = []
    for kind, n in enumerate(sample):
        own = sorted((r for r in rows if r.toxic == kind), key=lambda r: (r.code, r.doc_id))
        out += [(r.text, kind) for r in own[:n]]
    return out, share or 0.0


def fit(rows: list[tuple[str, int]], share: float, epochs: int = EPOCHS, seed: int = 0) -> ToxicityModel:
    """Train on labelled texts: each round on each document's highest windows and on random clean ones, at first on any.

    A fifth of the documents is set aside; with them, and more lightly with the
    others, the highest logit is turned into a probability, given the ``share`` of toxic documents in general. With one class only, every score is that class's share.
    """
    rng = np.random.default_rng(seed)
    kinds = {k for _, k in rows}
    if kinds != {0, 1}:
        model = ToxicityModel(gru.new_parameters(1), {}, 0.0, 8.0 if kinds == {1} else -8.0)
        model.slope = 1e-9
        return model
    place: dict[str, int] = {}
    split = [np.array([place.setdefault(w, len(place)) for w in words_of(t)], np.int32) for t, _ in rows]
    order = rng.permutation(len(rows))
    aside = set(order[::5].tolist())
    words = list(place)
    counts = np.zeros(len(words), np.int64)
    for i, ids in enumerate(split):
        if i not in aside:
            counts[np.unique(ids)] += 1
    by_count = np.argsort(-counts, kind="stable")[:MOST_WORDS]
    known = [words[i] for i in by_count if counts[i] >= LEAST_COUNT]
    model = ToxicityModel(gru.new_parameters(len(known) + 1, seed), {w: i + 1 for i, w in enumerate(known)})
    p, train = model.parameters, [i for i in order.tolist() if i not in aside and len(split[i])]
    if {rows[i][1] for i in train} != {0, 1}:
        return fit([], share)
    docs = [windows_over(split[i]) for i in train]
    kinds_of = np.array([rows[i][1] for i in train])
    owner = np.repeat(np.arange(len(train)), [len(d) for d in docs])
    windows, kind = np.concatenate(docs), kinds_of[owner]
    word_ids = np.array([model.vocabulary.get(w, 0) for w in words], np.int64)
    chars, offsets = gru.char_ngrams(words)
    adam = gru.Adam(p)
    batch = int(np.clip(2 * (kinds_of > 0).sum(), 32, BATCH))
    epochs = max(epochs, min(60, -(-LEAST_STEPS * batch // (4 * int(kinds_of.sum()) + 3 * len(train)))))
    warm = round(epochs * WARM_SHARE)
    for epoch in range(epochs):
        adam.rate = 0.02 if epoch < epochs - 2 else 0.005
        # At first some windows of each document, whatever they are; then those by which it is judged: the highest ones.
        inputs = gru.word_inputs(p, word_ids, chars, offsets)
        height = rng.random(len(windows)) if epoch < warm else window_logits(p, inputs, windows)
        by_height = np.lexsort((-height, owner))
        place_in = np.arange(len(owner)) - np.repeat(np.flatnonzero(np.diff(owner, prepend=-1)), np.bincount(owner))
        most = np.where(kind > 0, 4 if epoch < warm else 2, 3)[by_height]
        take = by_height[place_in < most]
        take = np.concatenate([take, rng.choice(np.flatnonzero(kind == 0), len(take))])
        take = rng.permutation(take)
        y = kind[take].astype(np.float32)
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
        for at in range(0, len(take), batch):
            part = slice(at, at + batch)
            _train_step(p, adam, windows[take[part]], y[part], weight[part], word_ids, chars, offsets, rng)
    logits = np.concatenate([model.best_logits([t for t, _ in rows[a : a + 200]]) for a in range(0, len(rows), 200)])
    trust = np.array([1.0 if i in aside else TRAINED_WEIGHT for i in range(len(rows))])
    model.slope, model.shift = fit_platt(logits, np.array([k for _, k in rows], float), share, trust)
    return model


def _train_step(p, adam, windows, y, weight, word_ids, chars, offsets, rng) -> None:
    """One step of Adam on a batch of windows of word places. A third of the word embeddings
    is left out, so that the characters have to do as well."""
    used, inverse = np.unique(windows, return_inverse=True)
    inverse = inverse.reshape(windows.shape) - int(used[0] < 0)
    used = used[used >= 0]
    ids = np.where(rng.random(len(used)) < 1 / 3, 0, word_ids[used])
    sizes = offsets[used + 1] - offsets[used]
    own = np.zeros(len(used) + 1, np.int64)
    np.cumsum(sizes, out=own[1:])
    at = np.arange(own[-1]) - np.repeat(own[:-1] - offsets[used], sizes)
    grams = chars[at]
    inputs = gru.word_inputs(p, ids, grams, own)
    g, d_inputs, _ = gru.gradients(p, inputs, inverse, y, weight)
    g["word"] = gru.summed_at(ids, d_inputs[:, : gru.WORD_DIM], len(p["word"]))
    g["word"][0] = 0
    by_gram = np.repeat(d_inputs[:, gru.WORD_DIM :] / np.maximum(sizes, 1)[:, None].astype(np.float32), sizes, axis=0)
    g["char"] = gru.summed_at(grams, by_gram, len(p["char"]))
    adam.step(g)


def fit_platt(logits: np.ndarray, y: np.ndarray, share: float, trust: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over logits, class 1 weighing ``share``, lightly held back."""
    center, scale = float(np.median(logits)), float(np.std(logits)) + 1e-6
    x = (logits - center) / scale
    own = (trust * y).sum() / trust.sum()
    w = trust / trust.mean() * np.where(y > 0, share / max(own, 1e-6), (1 - share) / max(1 - own, 1e-6))
    a, b = 1.0, 0.0
    for _ in range(100):
        q = gru.sigmoid(a * x + b)
        r, h = w * (q - y), w * q * (1 - q) + 1e-9
        grad = np.array([(r * x).mean() + 1e-3 * a, r.mean()])
        hess = np.array([[(h * x * x).mean() + 1e-3, (h * x).mean()], [(h * x).mean(), h.mean() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return a / scale, b - a * center / scale


def with_toxicity(docs: DataFrame, model: ToxicityModel, kept: list[str]) -> DataFrame:
    """Columns ``kept`` of ``docs`` plus score, read off all windows of each whole text.

    A null text, or one without words, has the score of no evidence, near 0. Whole
    texts are scored, of any length; no rows give none.
    Rows stay as they are, repeated ones too. A column called score is replaced.
    """
    kept = [c for c in kept if c != "score"]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    wanted = list(dict.fromkeys([*kept, "text"]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = model.scores(batch.column("text").to_pylist()).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], [*kept, "score"])

    return docs.select(*(F.col(f"`{c}`") for c in wanted)).mapInArrow(score, ", ".join([*fields, "score double"]))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels nothing is learned from; a null doc_id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained_on(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> ToxicityModel:
    return fit(*sample_texts(docs, labels.where(~held_out(F.col("doc_id"))), sample))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_toxicity(docs, trained_on(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    flag = held_out(F.col("doc_id"))
    return found.select("doc_id", flag.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
