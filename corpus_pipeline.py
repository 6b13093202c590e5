"""Corpus pipeline: language ID, one of each near-duplicate group, secrets out of sight, mixing, BPE digests.

Each stage takes all documents that the one before kept, and its result is written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rulegrain.llm import stages
from rulegrain.llm.common import documents, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.known_language(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed_sources(docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("bpe_codec", bpe_codec),
]

#: A trained model, and decoding by worklist, are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
