"""Token counts by a public tokenizer: encoded in Arrow functions that return lengths only.

White space separates tokens in the word-level vocabulary, so cutting a text there never changes its
tokens: those cuts are the safe boundaries. Texts are cut into segments, the segments' words are encoded
once each per worker (a bounded store keeps the lengths), and what is not in the store goes to the
library in batches that are balanced by bytes, not by rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

#: Bytes of text that go to the library in one call.
BATCH_BYTES = 1 << 20
#: Characters of a text that are looked at together.
SEGMENT_CHARS = 1 << 20
#: Words whose lengths a worker keeps.
STORE_WORDS = 400_000
#: Longer words are not kept.
STORE_CHARS = 64

#: Texts with nothing beyond this range, lower-cased too, have letters and digits that no Unicode version moves.
BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
#: There, what the vocabulary's splitting rule keeps together (after lower-casing).
LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\t-\\r \x85\xa0{LETTERS}{DIGITS}]+")

RESULT = "struct<n_bytes: bigint, n_tokens: bigint>"


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@cache
def _store(path: str) -> dict[str, int]:
    return {}


def balanced(words: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Cut words into runs of about limit bytes (a longer word is alone in its run)."""
    run, size = [], 0
    for w in words:
        n = len(w) * (1 if w.isascii() else 3)
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(w)
        size += n
    if run:
        yield run


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[list[str]]:
    """The words of a text (in Latin texts the pieces of words), cut at white space, about limit characters at a time."""
    special = "<|" in text
    at = 0
    while at < len(text):
        end = at + limit
        if end < len(text):
            end = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 or end
            if end == at + limit:  # no boundary: take the next one, however far
                nexts = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
                end = min(nexts, default=len(text))
        part = text[at:end]
        low = part.lower()
        if not special and (part.isascii() or not (BEYOND_LATIN.search(part) or BEYOND_LATIN.search(low))):
            yield PIECES.findall(low)
            at = end
            continue
        if "\n" in part or "\t" in part or "\r" in part:
            part = part.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        yield part.split(" ")
        at = end


def count_texts(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text, as the library counts them without added special tokens."""
    tok, store = tokenizer(path), _store(path)
    if not store:
        store[""] = 0
    out = []
    for text in texts:
        total = 0
        for words in segments(text or ""):
            try:
                total += sum(map(store.__getitem__, words))
                continue
            except KeyError:
                new = [w for w in dict.fromkeys(words) if w not in store]
            if len(store) + len(new) > STORE_WORDS:
                store.clear()
                store[""] = 0
                new = [w for w in dict.fromkeys(words) if w]
            for run in balanced(new):
                for w, e in zip(run, tok.encode_batch_fast(run, add_special_tokens=False), strict=True):
                    store[w] = len(e)
            total += sum(map(store.__getitem__, words))
            for w in new:
                if len(w) > STORE_CHARS:
                    del store[w]
        out.append(total)
    return out


def lengths(text: Column | str, path: str) -> Column:
    """Arrow function: struct<n_bytes, n_tokens> of a text column. Null counts as empty."""

    @F.arrow_udf(RESULT)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array(n_bytes, pa.int64()), pa.array(count_texts(texts, path), pa.int64())],
                names=["n_bytes", "n_tokens"],
            )

    return measure(text)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row of docs.

    Nulls: a null text counts as empty (0 bytes, 0 tokens); a null key is passed on. Repeated rows are
    counted one by one. Other columns are not read, whatever their names. An empty table gives an empty
    result. Texts of any length are counted whole, a segment at a time. path must name a vocabulary that
    drops white space (as word_bpe_49k.json does), else words can't be counted alone.
    """
    ready(docs.sparkSession)
    counted = docs.select(F.col(key), lengths(F.col(text), path).alias("_n"))
    return counted.select(
        key,
        F.col("_n.n_bytes").alias("n_bytes"),
        F.col("_n.n_tokens").alias("n_tokens"),
        (F.col("_n.n_tokens") > limit).alias("over_limit"),
    )
