"""The corpus pipeline: quality, near duplicates, secrets, mixing and tokens, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import stages
from dialoom.llm.shared import Scratch, table

STAGES = [
    ("quality", stages.keep_good_texts),
    ("near_duplicates", stages.keep_one_of_each),
    ("secrets", stages.mask_secrets),
    ("mixing", stages.mix_sources),
    ("tokens", stages.encode),
]

#: The stages on shingles, guess costs and tokens have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; every stage's rows are written as Parquet and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
