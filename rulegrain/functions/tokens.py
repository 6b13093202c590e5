"""Token counts by a byte-level BPE vocabulary, which is a file at hand.

A splitting pattern cuts texts into pieces inside Spark. Most pieces are tokens themselves: a join with the
vocabulary, whose size is bounded, settles these. All others are made distinct over all texts, and each is
merged once: neighbours join by ascending rank, told by a heap. Lengths are joined back and summed by text.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.settled import settled

# The splitting patterns of public vocabularies, for texts in Unicode.
PATTERNS = {
    "gpt2": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "cl100k_base": r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
    "o200k_base": r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+",
}
#: A vocabulary with more entries isn't sent to all tasks.
MOST_ENTRIES = 2_000_000
#: Lengths of pieces that counter() keeps.
KEPT_PIECES = 100_000

Rank = Callable[[bytes, bytes], int | None]


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabularies written as text: printable Latin ones for themselves, then the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """Tokens as bytes, the ranks by which neighbours join, and the pattern of pieces. by_pair: ranks are of pairs, else of what they give."""

    tokens: frozenset[bytes]
    ranks: dict
    by_pair: bool
    pattern: str

    def rank(self, left: bytes, right: bytes) -> int | None:
        return self.ranks.get((left, right) if self.by_pair else left + right)

    @cached_property
    def whole(self) -> list[str]:
        """Pieces that are one token."""
        found = []
        for t in self.tokens:
            try:
                text = t.decode()
            except UnicodeDecodeError:
                continue
            if text and merged(t, self) == 1:
                found.append(text)
        return sorted(found)


def merged(piece: bytes, vocabulary: Vocabulary) -> int:
    """How many tokens a piece has once neighbours have joined, the smallest rank first, of equal ones the leftmost."""
    n = len(piece)
    if n < 2:
        return n
    rank = vocabulary.rank
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = behind[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue  # one of them has joined another
        parts[i], parts[j] = a + b, None
        left -= 1
        k = behind[i] = behind[j]
        if k < n:
            before[k] = i
            if (r := rank(parts[i], parts[k])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        h = before[i]
        if h >= 0 and (r := rank(parts[h], parts[i])) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return left


def load_vocabulary(path: str, pattern: str = "gpt2") -> Vocabulary:
    """A vocabulary of base64 tokens with ranks, line by line, or a JSON file with `model.vocab` and `model.merges` in byte letters.

    pattern: a name of PATTERNS, or a regular expression. Raises ValueError for what is neither.
    """
    split = PATTERNS.get(pattern, pattern)
    with open(path, "rb") as f:
        data = f.read()
    if not data.lstrip().startswith(b"{"):
        try:
            ranks = {base64.b64decode(token, validate=True): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}
        except ValueError as e:
            raise ValueError(f"{path} is no vocabulary: {e}") from None
        return Vocabulary(frozenset(ranks), ranks, False, split)
    model = json.loads(data).get("model", {})
    if model.get("type", "BPE") != "BPE" or not model.get("merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        raise ValueError(f"{path} is no byte-level BPE vocabulary")
    letters = _byte_letters()
    as_bytes = lambda token: bytes(letters[c] for c in token)
    try:
        pairs = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        tokens = frozenset(map(as_bytes, model["vocab"]))
    except KeyError as e:
        raise ValueError(f"{path} has {e} in a token, which stands for no byte") from None
    return Vocabulary(tokens, {pair: i for i, pair in enumerate(pairs)}, True, split)


def java_pattern(pattern: str) -> str:
    """A pattern for Spark's functions: white space is Unicode's there too."""
    return f"(?U){pattern}"


def pieces(text: Column, vocabulary: Vocabulary) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(vocabulary.pattern)), F.lit(0))


def token_counts(rows: DataFrame, keys: list[str], text: str, vocabulary: Vocabulary, name: str = "tokens") -> DataFrame:
    """keys and the number of tokens of each row's text, as a long column.

    keys tell rows apart (rows of equal keys are summed). A null text has none, and so has an empty one; an empty
    table gives an empty result; other columns are not read. Texts are taken whole.
    """
    spark = rows.sparkSession
    if len(vocabulary.tokens) > MOST_ENTRIES:
        raise ValueError(f"a vocabulary of {len(vocabulary.tokens)} tokens is beyond what is sent to all tasks ({MOST_ENTRIES})")
    known = spark.createDataFrame(pa.table({"_piece": pa.array(vocabulary.whole, pa.string())})).withColumn("_known", F.lit(True))
    said = rows.select(*keys, F.explode(pieces(F.col(text), vocabulary)).alias("_piece")).join(F.broadcast(known), "_piece", "left")
    # what is a token itself counts at once; of the rest a row sends each piece once
    rest = F.when(F.col("_known").isNull(), F.col("_piece"))
    counted = settled(said.groupBy(*keys, rest.alias("_piece")).agg(F.count("*").alias("_n")), "pieces")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([merged(p.encode(), vocabulary) for p in b.column(0).to_pylist()], pa.int64())], names=["_piece", "_length"])

    odd = counted.filter("_piece is not null")
    length = odd.select("_piece").distinct().mapInArrow(lengths, "_piece string, _length bigint")
    none = rows.select(*keys, F.lit(0).cast("long").alias("_n"))
    parts = [counted.filter("_piece is null").select(*keys, "_n"), odd.join(length, "_piece").select(*keys, (F.col("_n") * F.col("_length")).alias("_n"))]
    return none.unionByName(parts[0]).unionByName(parts[1]).groupBy(*keys).agg(F.sum("_n").alias(name))


def with_estimates(surfaces: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Surfaces with tokens_est by a vocabulary, instead of a quarter of their characters."""
    keys = ["repo_id", "surface_id"]
    told = token_counts(surfaces, keys, "raw", vocabulary, "_tokens")
    return surfaces.drop("tokens_est").join(told, keys).withColumn("tokens_est", F.col("_tokens").cast("int")).drop("_tokens").select(surfaces.columns)


def exact_counter(count: Callable[[str], int], attempts: int = 3) -> Callable[[DataFrame], DataFrame]:
    """A function that adds tokens_exact to surfaces by a service's count of a text (one argument, the text).

    Each distinct text is counted once, in tasks of their own; one that can't be counted, however often it is
    tried, has no exact count.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                told = None
                for _ in range(attempts):
                    try:
                        told = int(count(text))
                        break
                    except Exception:  # noqa: BLE001  a client's errors are its own
                        continue
                out.append(told)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], names=["_digest", "tokens_exact"])

    def run(surfaces: DataFrame) -> DataFrame:
        rows = surfaces.drop("tokens_exact").withColumn("_digest", F.sha2("raw", 256))
        distinct = rows.filter("raw is not null").groupBy("_digest").agg(F.min("raw").alias("raw"))
        told = settled(distinct.mapInArrow(counted, "_digest string, tokens_exact int"), "exact")  # asked once, however often the result is read
        return rows.join(told, "_digest", "left").drop("_digest")

    return run


class Counter:
    """Tokens of one text, where texts are packed one by one; the lengths of some pieces are kept."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary, self.split = vocabulary, regex.compile(vocabulary.pattern)
        self.length = lru_cache(KEPT_PIECES)(self._length)

    def __reduce__(self):
        return Counter, (self.vocabulary,)

    def _length(self, piece: str) -> int:
        return merged(piece.encode(), self.vocabulary)

    def __call__(self, text: str) -> int:
        return sum(self.length(m[0]) for m in self.split.finditer(text))
