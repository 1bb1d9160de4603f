"""A training-data pipeline over ``documents``: quality, exact dedup, near dedup, decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on what its
predecessor kept; its result is written as Parquet and read again as the next one's
docs. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import decontam, exact_dedup, packing, quality, simhash
from riskframe.llm.common import materialize, table
from riskframe.llm.queries import tokenizer_json


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier does not reject (score of 0.7 or more)."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.keep_first_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose SimHash fingerprints link up, the document with the smallest id."""
    return simhash.keep_one_per_group(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens."""
    return packing.with_crc(packing.pack(docs, tokenizer_json()))


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

#: SQL has neither the classifier, the fingerprints nor the tokenizer: the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows are the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage_{name}")
    return docs
