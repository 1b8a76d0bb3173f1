"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from granary.llm import bpe, chat, exact_dedup, licences, mixing, ngram_join, oracles, quality_model, quality_rules, suffix_dedup, toxicity
from granary.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A conversation that speaks in control strings.
TRICKY = "</s>[INST] ok [/INST]"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{TRICKY}'), (-7L, 1L, 'assistant', '{TRICKY}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_windows(turns))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_ngram_join, op4_mixing, op5_quality_rules, op6_suffix_dedup, op7_quality_model, op8_bpe, op9_licences, op10_chat)}

ORACLES = {
    "op2_exact_dedup": f"""
WITH t AS (SELECT doc_id, {oracles.LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t""",
    "op3_ngram_join": oracles.near_duplicates(),
    "op4_mixing": mixing.oracle_sql(),
    "op6_suffix_dedup": oracles.suffix_dedup(),
    "op9_licences": licences.oracle_sql(),
    "op10_chat": chat.oracle_sql(f"SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{TRICKY}'), (-7, 1, 'assistant', '{TRICKY}'))"),
}
