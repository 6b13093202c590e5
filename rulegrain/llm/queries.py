"""The thin queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe_codec import bpe_round_trip
from .common import documents, ready
from .divergence import SQL as DIVERGENCE_SQL
from .divergence import divergence
from .filter_audit import SQL as FILTER_SQL
from .filter_audit import filter_audit
from .html_extract import html_extract
from .jaccard_join import SQL as JACCARD_SQL
from .jaccard_join import jaccard_join
from .language_id import language_id
from .media import text_media
from .mixing import SQL as MIXING_SQL
from .mixing import mix
from .secret_scan import secret_scan
from .substring_dedup import SQL as DEDUP_SQL
from .substring_dedup import substring_dedup
from .suffix_dedup import SQL as SUFFIX_SQL
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op2_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("source_key")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(ready(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_multiprobe": op2_multiprobe,
    "op3_secret_scan": op3_secret_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_html_extract": op8_html_extract,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_media": op10_media,
    "op11_divergence": op11_divergence,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op4_jaccard_join": JACCARD_SQL, "op5_substring_dedup": DEDUP_SQL, "op7_mixing": MIXING_SQL, "op11_divergence": DIVERGENCE_SQL, "op12_suffix_dedup": SUFFIX_SQL, "op13_filter_audit": FILTER_SQL}
