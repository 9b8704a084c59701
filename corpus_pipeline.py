"""Documents to packed sequences: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage is written as Parquet and read again by the next; all but the last return the columns of documents.

Handling, whatever the stage: null ids pass through; null and empty texts have no words, so the quality rules reject them and later stages take
them as empty where they are given any; very long texts are worked on whole; of repeated rows, and of ties between copies of one id, the near-duplicate stage
keeps one by the text's hash; further columns are kept up to the last stage, whatever their names; empty tables give an empty table with the same columns,
and an empty benchmark removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sunlattice.llm import decontamination, ngram_join, packing, pii, quality_rules, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of the current policy keep."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of exact and near copies."""
    return ngram_join.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data redacted in text, and n_chars by the new text."""
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack_documents(docs, packing.default_vocabulary())


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", benchmark), ("pii", personal_data), ("packing", pack)]

#: Boosted trees, min-hashes and the tokenizer can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
