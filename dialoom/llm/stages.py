"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> the rows that go on, with the columns of documents.

Rows that repeat, null texts and extra columns are treated as the operators' modules say. Every stage reads all of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import bpe, jaccard, mixing, quality, secrets
from dialoom.llm.shared import Scratch, table


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score 0.5 or more by a classifier trained on the labelled documents among docs."""
    labels = table(spark, sf_dir, "labels")
    labelled = docs.select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")  # sent to all where Spark finds it small
    featured = Scratch(spark, "stage").table(quality.features(labelled), "features")
    return quality.keep_good(docs, quality.train(featured, labels))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate texts the rows of the least doc_id; rows without an id stay."""
    return jaccard.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked and n_chars counted anew where texts changed."""
    return secrets.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as many times as its source's target says, from none to three times."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids: every row's text as token ids."""
    rows = docs.select(F.struct("doc_id", "source").alias("of"), "text")
    return bpe.code(rows, id_col="of").select("doc_id.doc_id", "doc_id.source", F.size("ids").cast("long").alias("n_tokens"), "ids")
