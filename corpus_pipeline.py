"""Corpus pipeline: each stage is a training-data operator, takes (spark, docs, sf_dir) and returns a DataFrame.

The caller writes each stage's rows and reads them again as the next one's docs; ``run`` does so itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varipair.llm import common, decontaminate, jaccard, pieces, quality, suffixes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: that with the smallest doc_id."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that stand anywhere else too."""
    return suffixes.dedupe(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digests of the ids of each document and of what they decode to."""
    import public_tokenizers

    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"), 2)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("piece_ids", piece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot say what the Jaccard components and the suffix array do; the stages are tested by brute force.
ORACLE_SQL = None
