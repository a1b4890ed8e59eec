"""The corpus pipeline: stages over ``documents``, each on what the one before
it kept. Every stage is one operator of ``plantlens.llm`` whose decisions take
effect; its result is written as Parquet and read again for the next stage.

All stages but the last return the columns of ``documents``; the last returns
the encoded documents. Null and empty texts are rejected by the first stage, as
they have fewer than 50 words; rows without doc_id are treated as documents of
their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantlens.llm import bpe, decontaminate, minhash, quality, toxicity
from plantlens.llm.common import table, written
from plantlens.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that many documents of a source share are
    removed from the others."""
    return quality.keep_good(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one of the least doc_id stays."""
    return minhash.keep_first(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of the rest."""
    return bpe.encode_documents(docs, TOKENIZER, ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", civil),
    ("near_dedup", near_dedup),
    ("decontamination", without_benchmarks),
    ("bpe", encoded),
]

#: The classifier, the alignment and the encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
