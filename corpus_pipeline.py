"""The document pipeline: reject, identify, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, written
as Parquet and read again between stages. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tagveil.llm import jaccard, langid, mixing, packing, quality
from tagveil.llm.common import shared_dir, table

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality or toxic ones go; the classifier learns from the labels table."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    return langid.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; linked are five-word shingle sets with a Jaccard similarity of 0.8 or more.

    Golay keys of SimHash fingerprints propose, whole sets verify; a prefix filter proposes what fingerprints miss.
    """
    return jaccard.kept(docs, SHINGLE)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as their source's target takes them."""
    return mixing.mixed_rows(docs)


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("packing", window_packing),
]

#: Trained models and tokenizers are beyond SQL; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
