"""Corpus pipeline: each stage reads what the one before it kept, as Parquet in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import exact_dedup, mixing, sentencepiece, simhash, toxicity
from gridcast.session import stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.fit(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, one row with the smallest doc_id stays."""
    return simhash.keep_one(docs, repeats=False)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents, `ids` (the piece numbers of the text), and `round_trip`.

    All texts are decoded again; `round_trip` is false for one that does not
    come back, whose row stays. A column of one of these names is replaced.
    """
    back = f"decoded_{uuid.uuid4().hex}"
    rows = sentencepiece.encoded(docs, sentencepiece.model_bytes(), back=back)
    same = F.col(back).eqNullSafe(sentencepiece.readable(F.col("text")))
    return rows.withColumn("round_trip", same).drop(back)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: Fitted weights decide which rows stay, so the rows have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
