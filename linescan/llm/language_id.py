"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training documents by the tasks. The
weights are fitted on the driver by follow-the-regularised-leader with an
elastic net, on a bounded sample of feature vectors; a temperature, fitted on
the part of the sample that the weights did not see and against smoothed targets,
turns margins into calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import by_bytes, lists
from .tables import table

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: The weights are fitted on so many distinct texts of each language at most; a language's own are chosen by a hash of the text.
SAMPLE_PER_LANGUAGE = 600
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.002

_tables: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the n-grams of a whole text, in lower case, with all but letters as
    spaces. Nothing if the text is null or has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate(([32], np.where(is_letter, codes, 32), [32])).astype(np.uint32)
    found, rolled = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        rolled = (rolled[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            found.append((rolled ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    keys = np.concatenate(found)
    if len(keys) < 4096:
        buckets, counts = np.unique(keys, return_counts=True)
        return buckets.astype(np.int64), counts
    counts = np.bincount(keys, minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF values of unit length, with TF as 1 + ln(count)."""
        v = (1 + np.log(counts)) * self.idf[buckets]
        return v / max(np.sqrt(v @ v), 1e-12)

    def margins(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(buckets, counts) @ self.weights[buckets] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        buckets, counts = ngram_counts(text)
        if not len(buckets) or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax(self.margins(buckets, counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents of ``docs`` (text) each bucket occurs, and how many documents have a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for value in batch.column("text"):
                buckets, _ = ngram_counts(value.as_py())
                seen[buckets] += 1
                seen[BUCKETS] += len(buckets) > 0
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used])], ["bucket", "n"])

    # At most one row for each bucket, however many documents there are.
    counted = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BUCKETS + 1, np.int64)
    total[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return total[:BUCKETS], int(total[BUCKETS])


def sample_features(docs: DataFrame, per_language: int) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Language and n-gram counts of at most ``per_language`` distinct texts of each language of ``docs`` (text, lang).

    Copies of a text are one text here, so they do not take the places of others.
    """
    code, other = F.pmod(F.xxhash64("text"), F.lit(1 << 30)), F.xxhash64("text", F.lit(1))
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.approx_count_distinct(other, 0.01).alias("n")).collect()}
    if not sizes:
        return [], []
    # A hash of the text deals all texts; this share of them holds the first ``per_language``, but for bad luck, in which case fewer.
    wanted = per_language + 6 * per_language**0.5 + 20
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, wanted / (0.97 * n)))))
    few = docs.withColumn("code", code).where(F.col("code") <= share[F.col("lang")] * (1 << 30))
    few = few.withColumn("other", other).groupBy("lang", "code", "other").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("code", "other")
    few = few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).select("lang", "text", "place", "code")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = [ngram_counts(v.as_py()) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("code"), lists([b for b, _ in found], pa.int32()), lists([c for _, c in found], pa.int32())],
                ["lang", "code", "buckets", "counts"],
            )

    rows = few.mapInArrow(features, "lang string, code long, buckets array<int>, counts array<int>").toArrow().sort_by([("code", "ascending"), ("lang", "ascending")])
    langs = rows.column("lang").to_pylist()
    vectors = [(b.values.to_numpy(), c.values.to_numpy()) for b, c in zip(rows.column("buckets"), rows.column("counts"))]
    some = [i for i, (b, _) in enumerate(vectors) if len(b)]
    return [langs[i] for i in some], [vectors[i] for i in some]


def fit_ftrl(model: LanguageModel, vectors: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, epochs: int = EPOCHS) -> None:
    """FTRL-proximal with an elastic net; sets weights and bias. One row at a time, so an order of the rows is part of the fit."""
    classes = len(model.languages)
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights_at(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    inputs = [(np.append(b, np.int32(BUCKETS)), np.append(model.vector(b, c), 1.0).astype(np.float32)) for b, c in vectors]
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(inputs)):
            at, x = inputs[i]
            w = weights_at(at)
            p = softmax(x @ w)
            p[targets[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    found = weights_at(np.arange(BUCKETS + 1))
    model.weights, model.bias = found[:BUCKETS], found[BUCKETS]


def fit_temperature(margins: np.ndarray, targets: np.ndarray) -> float:
    """The temperature from 0.05 to 20 with the least log loss against smoothed targets.

    As in Platt's scaling, the target of n texts of a language is (n + 1) / (n + 2) for
    it, and the rest is shared by the others: n texts that are all told right leave
    room for the next one not to be. Without it, texts that are easy to tell apart
    would have no least loss, and every score would be 1.
    """
    classes = margins.shape[1]
    n = np.bincount(targets, minlength=classes)[targets]
    rest = 1 / (n + 2)
    wanted = np.repeat((rest / max(classes - 1, 1))[:, None], classes, 1)
    wanted[np.arange(len(targets)), targets] = 1 - rest
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    losses = [-(wanted * np.log(np.maximum(softmax(margins / t), 1e-300))).sum(1).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Model of the languages of ``docs`` (text, lang); rows lacking either are passed over."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    langs, vectors = sample_features(labelled, per_language)
    languages = sorted(set(langs))
    seen, total = document_frequencies(labelled) if languages else (np.zeros(BUCKETS), 0)
    idf = np.log((1 + total) / (1 + seen)) + 1
    model = LanguageModel(languages, idf, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)))
    targets = np.array([languages.index(x) for x in langs], np.int64)
    aside = np.arange(len(targets)) % 5 == 4
    if len(languages) > 1:
        fit_ftrl(model, [v for v, a in zip(vectors, aside) if not a], targets[~aside])
        if aside.any():
            margins = np.array([model.margins(*v) for v, a in zip(vectors, aside) if a])
            model.temperature = fit_temperature(margins, targets[aside])
    return model


def with_language(docs: DataFrame, model: LanguageModel, kept: list[str]) -> DataFrame:
    """Columns ``kept`` of ``docs`` plus lang_pred and score, read off each whole text.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if the model knows no language. Equal margins go to the language first
    in order. Rows stay as they are, repeated ones too. Columns called lang_pred
    or score are replaced. Texts are read whole, of any length; no rows give none.
    """
    kept = [c for c in kept if c not in ("lang_pred", "score")]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    wanted = list(dict.fromkeys([*kept, "text"]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = [model.predict(v.as_py()) for v in batch.column("text")]
            columns = [pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "lang_pred", "score"])

    return docs.select(*(F.col(f"`{c}`") for c in wanted)).mapInArrow(predict, ", ".join([*fields, "lang_pred string", "score double"]))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a null doc_id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained_on(docs: DataFrame) -> LanguageModel:
    return train(docs.where(~held_out(F.col("doc_id"))))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = with_language(docs, trained_on(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
