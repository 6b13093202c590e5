"""Seeded defects, to measure how many of them the analyzers catch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import with_ranks

#: Rules with fewer words aren't changed, and what the middle word becomes.
LEAST_WORDS, REPLACEMENT = 8, "sideways"


def spread_sample(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Up to n rows of each repository, evenly spread over their order: places floor(i * count / n)."""
    told = with_ranks(rows, ["repo_id"], [F.col(c) for c in order], "_rn", "_count")
    # place k is taken if some i below n has floor(i * count / n) = k, that is if the next multiple of count / n falls in it
    i = F.ceil(F.col("_rn") * n / F.col("_count"))
    taken = (F.col("_count") <= n) | ((i < n) & (F.floor(i * F.col("_count") / n) == F.col("_rn")))
    return told.filter(taken).drop("_rn", "_count")


def without_targets(files: DataFrame, targets: DataFrame) -> DataFrame:
    """A file index (repo_id, path) without what references resolve to (repo_id, targets): they must then be found stale."""
    gone = targets.select("repo_id", F.explode("targets").alias("path")).distinct()
    return files.join(gone, ["repo_id", "path"], "left_anti")


def one_word_changed(text: Column) -> Column:
    """A rule with its middle word replaced: a copy that has drifted."""
    words = F.split(text, r"\s+")
    middle = F.floor(F.size(words) / 2).cast("int")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == middle, REPLACEMENT).otherwise(w)), " ")


def planted(rules: DataFrame, verbatim: bool) -> DataFrame:
    """Rules of a planted surface: copies of rules of at least LEAST_WORDS words, as they are or with one word changed."""
    long = rules.filter(F.size(F.split("text", r"\s+")) >= LEAST_WORDS)
    text = F.col("text") if verbatim else one_word_changed(F.col("text"))
    return long.withColumns({"text": text, "rule_id": F.concat(F.lit("seeded:"), "rule_id"), "surface_id": F.lit("seeded"), "ord": F.col("ord") + 1_000_000})


def caught(seeded: DataFrame, findings: DataFrame, categories: list[str]) -> DataFrame:
    """seeded (repo_id, rule_id, defect) with whether a finding of the categories names the rule."""
    told = findings.filter(F.col("category").isin(categories)).select("repo_id", F.explode("rule_ids").alias("rule_id")).distinct().withColumn("hit", F.lit(True))
    return seeded.join(told, ["repo_id", "rule_id"], "left").select("repo_id", "rule_id", "defect", F.col("hit").isNotNull().alias("caught"))
