"""Operators as stages of a corpus pipeline: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .bpe_codec import bpe_round_trip
from .common import ready, table
from .jaccard_join import jaccard_join, node_of
from .language_id import UNKNOWN, fit, held_out, predicted
from .mixing import mix
from .secret_scan import secrets

#: Documents whose most probable language is less probable than this are rejected.
LEAST_SCORE = 0.5


def fresh(docs: DataFrame, stem: str) -> str:
    """A column name that docs doesn't have."""
    name = stem
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def known_language(docs: DataFrame) -> DataFrame:
    """Documents with a language: those that are `und`, or less probable than LEAST_SCORE, go. All columns stay as they are."""
    ready(docs.sparkSession)
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    p = fresh(docs, "_language")
    told = docs.withColumn(p, predicted(F.col("text"), model))
    return told.filter((F.col(f"{p}.lang_pred") != UNKNOWN) & (F.col(f"{p}.score") >= LEAST_SCORE)).drop(p)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The smallest document of each component of near duplicates; of its repeated rows, one. Documents without words, or with a null doc_id, stay.

    Rows of one doc_id with different texts are different documents.
    """
    h, u = fresh(docs, "_h"), fresh(docs, "_u")
    gone = jaccard_join(docs, nodes_only=True).filter("first <> node").select("doc_id", F.col("node").alias(h))
    left = docs.withColumn(h, node_of("doc_id", "text")).join(gone, ["doc_id", h], "left_anti")
    numbered = left.withColumn(u, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    # of rows with one doc_id and text the one with the smallest other columns, whatever order they come in
    r = fresh(docs, "_row")
    smallest = F.struct(*(F.col(c) for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)))
    return numbered.groupBy("doc_id", h, u).agg(F.min_by(F.struct(*(F.col(c) for c in docs.columns)), smallest).alias(r)).select(f"{r}.*")


def without_secrets(docs: DataFrame) -> DataFrame:
    """Documents with every secret found, encoded ones too, put out of sight; n_chars follows the text. Clean documents stay as they are."""
    ready(docs.sparkSession)
    s = fresh(docs, "_secrets")
    told = docs.withColumn(s, secrets(F.col("text")))
    found = F.length(f"{s}.spans") > 0
    new = told.withColumn("text", F.when(found, F.col(f"{s}.redacted")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(found, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return new.drop(s).select(docs.columns)


def mixed_sources(docs: DataFrame) -> DataFrame:
    """The mix: each row as often as it is taken, up to three times."""
    r, n, e = (fresh(docs, x) for x in ("_r", "_n", "_e"))
    # keys may be null or repeated, so rows are told by numbers, which are written for both sides of the join to agree
    numbered = table(docs.withColumn(r, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, row=r).filter("taken > 0").select(r, (F.col("taken") / F.col("size")).cast("int").alias(n))
    joined = numbered.join(taken, r)
    return joined.withColumn(e, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(docs.columns)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """The result of BPE encoding and decoding, for each document that is left."""
    return bpe_round_trip(docs, path)
