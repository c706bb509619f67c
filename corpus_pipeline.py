"""Training-data pipeline: from documents to packed sequences.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's documents. Stages that filter return the columns
of documents; the last one returns the pieces and their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadencia.llm import langid, minhash, packing, pii, quality
from cadencia.llm.common import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, of which one language has more than a third."""
    return langid.accepted(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked at 0.8."""
    return minhash.deduplicated(docs, k=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without personal data and the terms that disclose it."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    cut = packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
    return packing.pack(cut, carry=("ids_crc32",))


STAGES = [
    ("language ID", language),
    ("quality classifier", good),
    ("MinHash near-dedup", unique),
    ("PII", private),
    ("best-fit packing", packed),
]

#: SQL can state neither the classifiers nor the tokens; tests hold each stage against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else stored(docs)
    return docs
