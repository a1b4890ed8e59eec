"""The registered queries of this subpackage, over whole tables, with the
parameters meant for production, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm import bpe, decontaminate, html_text, licenses, minhash, packing, prefix_trie, quality, repair, token_counts, token_store, toxicity, url_filter
from plantlens.llm.common import table, written
from plantlens.llm.oracles import ORACLE_SQL  # noqa: F401

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.document_lengths(table(spark, sf_dir, "documents"), TOKENIZER, ["lang"])
    return token_counts.length_histogram(lengths, ["lang"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"))
    return judged.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations")
    damaged = repair.damage_conversations(whole)
    plans = written(repair.plan_repairs(damaged), "repairs")
    digests = repair.conversation_digests(repair.repaired_turns(damaged, plans))
    ids = whole.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = ids.join(plans, F.col("id").eqNullSafe(plans.conv_id), "left").drop("conv_id")
    found = found.join(digests, F.col("id").eqNullSafe(digests.conv_id), "left")
    return found.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("conv").cast("string")) % 4
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), head, F.col("conv") - F.col("conv") % 20)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_decontamination, op4_minhash_dedup, op5_bpe_roundtrip, op6_url_filter, op7_quality_rules, op8_html_text, op9_toxicity, op10_token_store, op11_conversation_repair, op12_packing, op13_prefix_trie)}
