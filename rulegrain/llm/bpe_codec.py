"""BPE encoding and decoding with tree concatenation for long unsplit text.

A text is cut where the vocabulary's own splitting rule always cuts (before a space that follows a
non-space and precedes one, and around runs of white space), and each piece is encoded by the library.
Text that the rule leaves unsplit for long is halved down to leaves; the leaves are encoded in parallel
and joined pairwise up the tree: around each join a window of tokens is encoded anew and grown until its
first and last tokens agree with the left and right side. As a token sequence is the one that BPE gives
exactly if all its neighbours fit, the joined sequence is exact.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

#: Code points that the splitting rule takes as white space.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNITS = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: In texts with nothing beyond this range no Unicode version moves letters and digits, so words can be cut as the rule does.
BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Characters of unsplit text up to which it is encoded in one go.
LEAF_CHARS = 4096
STORE_UNITS = 250_000
STORE_CHARS = 64

RESULT = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"


def byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: printable ones are themselves, the rest follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def concatenate(left: list[int], right: list[int], encode: Callable[[str], list[int]], letters: Callable[[int], str]) -> list[int]:
    """The tokens of left's text followed by right's, given the tokens of each."""
    if not left or not right:
        return left or right
    k = 2
    while True:
        i, j = max(0, len(left) - k), min(len(right), k)
        window = encode("".join(map(letters, left[i:] + right[:j])))
        fits_left = i == 0 or window[0] == left[i]
        fits_right = j == len(right) or window[-1] == right[j - 1]
        if fits_left and fits_right:
            return left[:i] + window + right[j:]
        k *= 2


def tree(text: str, encode_all: Callable[[list[str]], list[list[int]]], letters: Callable[[int], str], leaf: int = LEAF_CHARS) -> list[int]:
    """Tokens of unsplit text (in byte letters): leaves in parallel, then joins up the tree."""
    leaves = [text]
    while len(leaves[0]) > leaf:
        leaves = [half for x in leaves for half in (x[: len(x) // 2], x[len(x) // 2 :])]
    level = encode_all(leaves)
    one = lambda s: encode_all([s])[0]
    while len(level) > 1:
        level = [concatenate(level[i], level[i + 1], one, letters) for i in range(0, len(level), 2)]
    return level[0]


class Codec:
    """Encodes and decodes whole texts as the library does, without added special tokens."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.lib = Tokenizer.from_str(json.dumps(told | {"truncation": None, "padding": None}))
        bare = told | {"truncation": None, "padding": None, "normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.piece = {i: p for p, i in told["model"]["vocab"].items()}
        letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(letters)}
        self.letter = {b: c for b, c in enumerate(letters)}
        self.leaf = leaf
        self.bytes = {i: bytes(map(self.byte.__getitem__, p)) for i, p in self.piece.items() if p not in self.special} | {i: s.encode() for s, i in self.special.items()}
        #: unit -> (number of ids, ids joined by commas, bytes that the ids decode to)
        self.store: dict[str, tuple[int, str, bytes]] = {}

    def _encode_bare(self, texts: list[str]) -> list[list[int]]:
        task = TaskContext.get()  # halves are encoded in parallel on as many cores as the task owns (spark.task.cpus)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if len(texts) > 1 and (task is None or task.cpus() > 1) else "false"  # the library reads it at each call
        return [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]

    def _long(self, unit: str) -> list[int]:
        ids: list[int] = []
        for letters, _ in self.lib.pre_tokenizer.pre_tokenize_str(unit):
            ids += tree(letters, self._encode_bare, self.piece.__getitem__, self.leaf)
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def _learn(self, units: list[str]) -> None:
        short = [u for u in units if len(u) <= self.leaf]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for u, e in zip(short, self.lib.encode_batch_fast(short, add_special_tokens=False), strict=True):
            self.store[u] = (len(e.ids), ",".join(map(str, e.ids)), self.decode_bytes(e.ids))
        for u in units:
            if len(u) > self.leaf:
                ids = self._long(u)
                self.store[u] = (len(ids), ",".join(map(str, ids)), self.decode_bytes(ids))

    def parts(self, text: str) -> Iterator[tuple[int, str, bytes]]:
        """Of each unit in turn: number of ids, ids, decoded bytes."""
        store = self.store
        rule = UNITS if BEYOND_LATIN.search(text) else PIECES
        for k, span in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield 1, str(self.special[span]), span.encode()
                continue
            for at in range(0, len(units := rule.findall(span)), 100_000):
                some = units[at : at + 100_000]
                if new := [u for u in dict.fromkeys(some) if u not in store]:
                    if len(store) + len(new) > STORE_UNITS:
                        store.clear()
                        new = list(dict.fromkeys(some))
                    self._learn(new)
                yield from map(store.__getitem__, some)
                for u in new:
                    if len(u) > STORE_CHARS:
                        del store[u]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text) for i in ids.split(",")]

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the decoded text."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        rest = list(self.parts(text or ""))
        # byte pieces of one character can fall into two units only if the text itself isn't valid; decode the whole
        for at in range(0, len(rest), 50_000):
            some = rest[at : at + 50_000]
            n += sum(x[0] for x in some)
            ids_hash.update(((b"," if at else b"") + ",".join([x[1] for x in some]).encode()))
            text_hash.update(b"".join([x[2] for x in some]).decode("utf-8", "replace").encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def round_trip(text: Column | str, path: str) -> Column:
    """Arrow function: struct<n_tokens, ids_sha256, decoded_sha256> of a text column. Null counts as empty."""

    @F.arrow_udf(RESULT)
    def run(batch: pa.Array) -> pa.Array:
        c = codec(path)
        rows = [c.digest(t) for t in batch.to_pylist()]
        n, ids, out = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return run(text)


def encode(text: Column | str, path: str) -> Column:
    """Arrow function: the ids of a text column as array<int>. Null stays null."""

    @F.arrow_udf("array<int>")
    def run(batch: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if t is None else c.encode(t) for t in batch.to_pylist()], pa.list_(pa.int32()))

    return run(text)


def decode(ids: Column | str, path: str) -> Column:
    """Arrow function: the text of a column of ids. Null stays null."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if x is None else c.decode(x) for x in batch.to_pylist()], pa.string())

    return run(ids)


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 for each row of docs.

    Nulls: a null text counts as empty (no ids; digests of nothing), a null key is passed on. Repeated rows
    are encoded one by one and agree. Other columns are not read. An empty table gives an empty result.
    Texts of any length are encoded whole.
    """
    ready(docs.sparkSession)
    done = docs.select(F.col(key), round_trip(F.col(text), path).alias("_n"))
    return done.select(key, "_n.n_tokens", "_n.ids_sha256", "_n.decoded_sha256")
