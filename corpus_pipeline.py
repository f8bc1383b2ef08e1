"""The corpus pipeline: quality rules, near-duplicate removal, passage removal, benchmark decontamination, BPE ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import bpe, decontam, minhash, quality_rules, scratch, substring
from kindred.llm.queries import table, vocabulary_path

#: Stages that pick by quantile sketches, signatures or BPE merges are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller doc_id has are taken out of the text."""
    return substring.remove_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark passage go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document that is left: its number of tokens, and digests of its ids and of the text decoded from them."""
    return bpe.bpe_digest(docs, vocabulary_path())


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", substrings), ("benchmark passages", benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = scratch.save(out, name.replace(" ", "-"))
    return out
