"""Corpus pipeline: toxic documents go, one of each group of near duplicates stays, personal data is masked, the rest is packed.

Each stage reads the documents that the stage before it wrote. ORACLE_SQL is None: the fitted model and the
tokenizer have no SQL; tests/llm compares each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.llm import jaccard, packing, pii, toxicity as machine
from rainloom.llm.common import table
from rainloom.session import cut_lineage

THRESHOLD = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the model learns from the labels of documents outside the held-out fifth."""
    model = machine.train(docs, table(spark, sf_dir, "labels").where(~machine.held_out()))
    name = "_score" + "_" * max(map(len, docs.columns))
    return machine.score(docs, model, name).where(F.col(name) < THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data masked; n_chars follows the new text."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
