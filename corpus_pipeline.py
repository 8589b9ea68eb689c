"""Corpus pipeline: documents in, encoded training documents out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, extra ones included, whatever their names. Null doc_ids
and sources are documents like others; an empty table gives an empty result. Before each, executors give back what the one
before has left in their heaps.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from tidewire.llm.common import cut, relieve, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, null texts among them; all others are in the learned language that suits them best."""
    relieve(spark)
    return language_id.accepted(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays, once; a null doc_id stays only if all rows of its text have none."""
    relieve(spark)
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links (five-word shingles, Jaccard 0.8 or more) the smallest doc_id stays; null doc_ids all stay."""
    relieve(spark)
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: a document comes out as often as the mix takes it, 0 to 2 times."""
    relieve(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids; a row per row, null texts count as empty."""
    relieve(spark)
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", language),
    ("exact_dedup", copies),
    ("ngram_jaccard", near_copies),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: A trained network decides in the first stage, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row, from the table documents; what encode() returns for the documents that remain."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
