"""A corpus pipeline: quality filter, exact and near deduplication, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last return the
columns of documents. Rows are told apart by their place in the Parquet files that a stage reads (a docs made otherwise is
written once), so ids may be null or repeat; a join or explode that repeats rows has to be written before a stage, as run() does. A null text counts as an empty one in
every stage, an empty table gives an empty result, and columns beside those of documents pass through unread, but for the last stage, which returns its own. run() writes each stage's result to the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, exact_dedup, mixing, ngram_join, quality_model
from granary.llm.common import materialise, table
from granary.llm.queries import RANKS
from granary.llm.sampling import held_out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under one half go. It is fitted on labelled rows of docs."""
    trees = quality_model.train(docs, table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 3, 1))
    return docs.filter(quality_model.scorer(trees)(F.col("text")) >= 0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, in a single row."""
    return exact_dedup.keep_one(docs, repeats=False, placed=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays, in a single row."""
    return ngram_join.keep_one(docs, placed=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; where a source's budget ends inside a document, its text up to there."""
    return mixing.take(docs, placed=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, exact: the ids of each text, and whether they decode to it."""
    return bpe.encode_checked(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing to target weights", mixed), ("byte-level BPE", tokens)]
#: Trained trees and merges are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
