"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote and works on all of it; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import exact_dedup, mixing, packing, quality_classifier, simhash
from colloquy.llm.queries import table, vocabulary_path
from colloquy.operators.staging import stage


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels that belong to ``docs``."""
    return quality_classifier.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs).kept()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that the SimHash operator links (three-word shingles, 3 differing bits) the smallest doc_id stays."""
    return simhash.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents of short sources come twice."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality classifier", classify_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

# Neither training nor fingerprints nor token ids can be stated in SQL; tests rebuild each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
