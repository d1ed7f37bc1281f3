"""From raw documents to token ids, in five stages.

Each stage is a function of (session, documents, folder of the given tables)
and works on all that the one before it kept. All but the last return the
columns of documents. A stage's result is written before the next one reads it,
so a lost executor repeats work of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.llm import jaccard, langid, mixing, quality
from stowage.llm.queries import GOOD_FROM, bpe_digests
from stowage.llm.tables import Scratch, free_name, table

#: A document in which no learned language has this part of the letters is rejected.
LANGUAGE_FROM = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or with no clear language among those learned."""
    model = langid.train(docs)
    found = langid.identify(docs, model, prefix="__")
    clear = (F.col("__lang_pred") != langid.UNDETERMINED) & (F.col("__score") >= LANGUAGE_FROM)
    return found.where(clear).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labels, finds bad."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, result_col="__quality")
    return scored.where(F.col("__quality") >= GOOD_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by shared word 5-grams: the one with the smallest id.

    Rows of one id are told apart by their texts: of several in one group the one
    with the smallest hash of its text stays, and of equal rows one. Documents
    without words form no group, nor do those without an id unless a document
    with an id has the same words; of equal ones one stays.
    """
    key = free_name("text_key", docs.columns)
    # The links' plan is long, so it is used once, for rows with an id and without.
    first = jaccard.linked_rows(docs).where("doc_id <=> component_id").groupBy(
        "doc_id", (F.col("n_shingles") > 0).alias("worded"),
        F.when(F.col("doc_id").isNull(), F.col("text_key")).alias("alone"),
    ).agg(F.min("text_key").alias("first_key")).select(F.col("doc_id").alias("first_id"), "first_key")
    rows = docs.withColumn(key, jaccard.text_key(F.col("text")))
    kept = rows.join(
        first, rows["doc_id"].eqNullSafe(first["first_id"]) & (rows[key] == first["first_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to their source's target rate, in a random order."""
    return mixing.mix_sources(docs).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's token ids and of the bytes they stand for."""
    return bpe_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix),
    ("byte_bpe", byte_bpe),
]

#: The classifiers' decisions have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{at}-{name}")
    return docs
