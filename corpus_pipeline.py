"""The corpus pipeline over ``documents``: five stages, each written and read again.

1. language: documents whose language cannot be told go.
2. toxicity: documents that the network finds toxic go.
3. near_duplicates: of documents linked by shared word shingles, one stays.
4. secrets: secrets inside the texts are replaced.
5. packing: the tokens of what is left, in sequences.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linescan.llm import jaccard, language_id, packing, secrets_scan, toxicity
from linescan.llm.tables import keep, passing, table

#: A document stays if its language has at least this probability.
LEAST_LANGUAGE_SCORE = 0.5

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and those whose language is a guess.

    A null or empty text has no letter, so it goes. Repeated rows and ties are
    judged row by row, by the whole text; no documents give none, and columns
    other than those of documents are left out.
    """
    found = language_id.with_language(docs, language_id.trained_on(docs), COLUMNS)
    sure = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select(*COLUMNS)


def low_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic, by any window of the whole text.

    A null or empty text is not toxic. Labels count for the documents that reached
    this stage. Repeated rows are judged alike; no documents give none.
    """
    model = toxicity.trained_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_toxicity(docs, model, COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def _one_row(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key."""
    rest = ["source", "lang", "n_chars", "text"]
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class, of its least doc_id; a doc_id with several texts is judged text by text.

    Texts that are null or without words are alike only under one doc_id, of which
    one row stays. Of repeated rows one stays, of several with unlike other columns
    that with the least source, then lang, n_chars and text, nulls first. Rows without
    a doc_id stay, copies among them too. Whole texts are compared; no documents give none.
    """
    docs = docs.select(*COLUMNS)
    found = keep(jaccard.text_classes(docs).where("doc_id IS NOT NULL").select("doc_id", "cid", "root", "class_id"), "text-classes")
    by_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts"), F.max("class_id").alias("class_id"))
    several = keep(by_id.where("texts > 1").select("doc_id"), "several")
    if several.count() <= jaccard.BROADCAST_ROWS:
        several = F.broadcast(several)
    named = docs.where("doc_id IS NOT NULL")
    left = by_id.where("texts > 1 OR class_id <> doc_id").select("doc_id")
    alone = _one_row(named.join(left, "doc_id", "left_anti"), "doc_id")
    # Of a class that holds several texts of its least doc_id, one of them stays.
    best = found.join(several, "doc_id", "left_semi").where("class_id = doc_id").groupBy("doc_id", "root").agg(F.min("cid").alias("cid"))
    texts = jaccard.with_class(named.join(several, "doc_id", "left_semi"))
    judged = _one_row(texts.join(best, ["doc_id", "cid"], "left_semi"), "doc_id", "cid")
    rows = [part.select(*COLUMNS) for part in (alone, judged, docs.where("doc_id IS NULL"))]
    return rows[0].union(rows[1]).union(rows[2])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret, private keys as a whole; texts without one stay as they are.

    All rows stay, repeated ones, null and empty texts (null stays null) and null
    doc_ids too; n_chars is that of the new text. Overlapping secrets get one mark.
    """
    docs = docs.select(*COLUMNS)
    found, _ = secrets_scan.scan_secrets(docs, rules=secrets_scan.WHOLE_RULES)
    hits = found.where(F.size("spans") > 0).select(F.col("blob").alias("hit"), "spans").dropDuplicates(["hit"])
    blob = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    marked = docs.join(hits, blob == F.col("hit"), "left")
    text = F.when(F.col("spans").isNotNull(), secrets_scan.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return marked.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences of 1024.

    A null text is packed as an empty one, repeated rows each by itself; no documents give no rows.
    """
    return packing.best_fit_packing(packing.token_pieces(docs))


STAGES = [
    ("language", language),
    ("toxicity", low_toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("packing", pack),
]

#: Trained models and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``. Tables that a stage kept on its way go when its result is kept."""
    docs, own = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with passing(spark) as made:
            docs = keep(stage(spark, docs, sf_dir), name)
            last, own = own, [made.pop()]  # the result is kept last
            made += last  # what it was made from has been read
    return STAGES[-1][1](spark, docs, sf_dir)
