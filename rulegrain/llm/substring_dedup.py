"""Substring dedup by super-k-mer partitioning.

A window is 13 consecutive words. The window's minimiser is its run of 3 words with the smallest hash; runs
that are the minimiser of very many windows, told from a sample of the documents, come after all others, so no
bucket holds much more than its share. Which runs these are changes where windows meet, not what is found.
Consecutive windows that share a minimiser travel as one packed string to the bucket of that minimiser, so
equal windows of all documents meet in one bucket. There they are sorted, and each one's smallest document
is found exactly: hashes only bring equal windows together, the words themselves are compared.

Map tasks send each distinct string once, with the smallest document that has it; a larger document of the
same batch is told at once that its windows are known. So a passage that a third of all documents share
reaches its bucket once for each batch, not once for each document.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, ready, trim

WINDOW, MINIMISER = 13, 3
WORD = re.compile(WORD_PATTERN)
BLANK = re.compile(r"[\x20\x09-\x0D]")
#: Input bytes for which there is one bucket.
BUCKET_BYTES = 4 << 20
#: Tasks that buckets are dealt to, at most.
MOST_PARTS = 20_000
#: Words of documents that a map task packs at once.
BATCH_WORDS = 250_000
#: Frequent minimisers are looked for among this many slots of hashes, in one of SAMPLED documents; one is frequent with more than FREQUENT of a task's mean windows.
SLOTS, SAMPLED, FREQUENT = 1 << 18, 16, 0.25
#: Characters of a text that are split into words at once.
SLICE_CHARS = 4 << 20

RUNS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
RUNS_DDL = "doc_id bigint, text_hash bigint, starts array<int>, counts array<int>"


def codes_of(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """Numbers for words (equal words, equal numbers), and the words by number."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.array([zlib.crc32(b) | zlib.adler32(b[::-1]) << 32 for b in map(str.encode, words)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values, from those of runs half as long."""
    if n == 1:
        return mixed(h + np.uint64(1))
    half = (n + 1) // 2
    part = rolled(h, half)
    last = len(h) - n + 1
    return mixed(part[:last] * np.uint64(3) + part[n - half : n - half + last] + np.uint64(n))


def slot_of(minimiser: np.ndarray) -> np.ndarray:
    return (minimiser & np.uint64(SLOTS - 1)).astype(np.int64)


def super_kmers(h: np.ndarray, lengths: np.ndarray, frequent: np.ndarray, window: int = WINDOW, m: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents' word hashes, end to end: where runs of windows with one minimiser begin, how many windows each has, its minimiser's hash and its document.

    Every document has a window's words at least. frequent tells of each slot whether its runs of words come last.
    """
    grams = rolled(h, m)
    grams = grams >> np.uint64(1) | frequent[slot_of(grams >> np.uint64(1))].astype(np.uint64) << np.uint64(63)
    span = window - m + 1
    low = grams[: len(grams) - span + 1].copy()
    for i in range(1, span):
        np.minimum(low, grams[i : len(grams) - span + 1 + i], out=low)
    # windows that reach over a document's end aren't windows
    ends = np.cumsum(lengths)
    inside = np.zeros(len(h) + 1, np.int64)
    inside[ends - lengths] += 1
    inside[ends - window + 1] -= 1
    real = np.cumsum(inside)[: len(low)] > 0
    first = np.ones(len(low), bool)
    first[1:] = low[1:] != low[:-1]
    first[(ends - lengths)[ends - lengths < len(low)]] = True
    starts = np.flatnonzero(first & real)
    document = np.searchsorted(ends, starts, side="right")
    until = np.minimum(np.append(starts[1:], len(low)), ends[document] - window + 1)
    return starts, until - starts, low[starts], document


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of a text's words, with the number of words before each; together they have every window once."""
    at, before, tail = 0, 0, []
    while at < len(text):
        end = at + size
        while end < len(text) and not BLANK.match(text, end):
            end += 1
        words = tail + WORD.findall(text, at, end)
        if len(words) >= WINDOW:
            yield before, words
            before += len(words) - WINDOW + 1
            words = words[len(words) - WINDOW + 1 :]
        at, tail = end, words


def _sharded(known: np.ndarray | list, shards: int) -> Iterator[tuple[int, bytes]]:
    """Runs (doc_id, text_hash, start, windows) as packed tables, by shard of doc_id."""
    if not len(known):
        return
    d, h, s, k = np.ascontiguousarray(np.asarray(known, np.int64).T)
    shard = (mixed(d.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((s, h, d, shard))
    cut = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for i, j in zip(cut, np.append(cut[1:], len(order)), strict=True):
        o = order[i:j]
        yield int(shard[o[0]]), to_bytes(pa.table({"d": d[o], "h": h[o], "s": s[o], "k": k[o]}))


def gather(tables: list[pa.Table]) -> pa.RecordBatch:
    """Runs of a shard, by document."""
    t = pa.concat_tables(tables)
    d, h, s, k = (t.column(c).to_numpy() for c in "dhsk")
    order = np.lexsort((s, h, d))
    d, h, s, k = d[order], h[order], s[order], k[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))
    offsets = pa.array(np.append(first, len(d)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (s, k)]
    return pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(h[first]), *lists], schema=RUNS)


BLOBS = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=BLOBS)


def frequent_slots(docs: DataFrame, parts: int) -> np.ndarray:
    """For each slot whether the minimisers in it have more windows than FREQUENT of what a task has on average, by a sample of documents.

    SLOTS numbers at most come to the driver.
    """
    none = np.zeros(SLOTS, bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                for _, ws in slices(text):
                    codes, distinct = codes_of(ws)
                    h = word_hashes(distinct)[codes]
                    starts, k, low, _ = super_kmers(h, np.array([len(ws)]), none)
                    _, once = np.unique(rolled(h, WINDOW)[starts], return_index=True)
                    np.add.at(n, slot_of(low[once]), k[once])
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(n[slot], pa.int64())], names=["slot", "n"])

    sample = docs.filter("doc_id is not null and text is not null").filter(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SAMPLED)) == 0)
    told = sample.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = told.column("slot").to_numpy(), told.column("n").to_numpy()
    found = none.copy()
    found[slot[n * parts > FREQUENT * n.sum()]] = True
    return found


def pack(batches: Iterator[pa.RecordBatch], buckets: int, shards: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text_hash, text) to rows (bucket, packed): super-k-mers by bucket; and runs known at once, by shard (bucket -1 - shard)."""

    def emit(todo: list[tuple[int, int, int, list[str]]]) -> pa.RecordBatch:
        words = [w for x in todo for w in x[3]]
        codes, distinct = codes_of(words)
        lengths = np.array([len(x[3]) for x in todo])
        starts, k, low, own = super_kmers(word_hashes(distinct)[codes], lengths, frequent)
        doc, text_hash, before = (np.array([x[i] for x in todo], np.int64) for i in range(3))
        doc, text_hash, at = doc[own], text_hash[own], before[own] + starts - (np.cumsum(lengths) - lengths)[own]
        joined = " ".join(words).encode()
        offsets = np.concatenate([[0], np.cumsum(np.array([len(w.encode()) for w in distinct], np.int64)[codes] + 1)])
        cuts = zip(offsets[starts].tolist(), (offsets[starts + k + WINDOW - 1] - 1).tolist(), strict=True)
        string = pa.array([joined[i:j] for i, j in cuts], pa.binary()).cast(pa.string())
        code = string.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        least = np.full(code.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, code, doc)
        later = doc > least[code]
        known = np.stack([doc[later], text_hash[later], at[later], k[later]], axis=1)
        bucket = np.where(later, buckets, (low % np.uint64(buckets)).astype(np.int64))
        order = np.argsort(bucket, kind="stable")[: len(bucket) - int(later.sum())]
        out = [(-1 - shard, data) for shard, data in _sharded(known, shards)]
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for i, j in zip(cut, np.append(cut[1:], len(order)), strict=True):
            o = order[i:j]
            out.append((int(bucket[o[0]]), to_bytes(pa.table({"d": doc[o], "h": text_hash[o], "s": at[o].astype(np.int32), "k": k[o].astype(np.int32), "t": string.take(pa.array(o))}))))
        return _blobs(out)

    todo: list[tuple[int, int, int, list[str]]] = []
    size = 0
    for batch in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
        for doc, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for before, ws in slices(text):
                todo.append((doc, text_hash, before, ws))
                size += len(ws)
                if size >= BATCH_WORDS:
                    yield emit(todo)
                    todo, size = [], 0
    if todo:
        yield emit(todo)
    del todo
    trim()


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether windows that begin at a and at b have the same words."""
    same = np.ones(len(a), bool)
    for i in range(WINDOW):
        same &= words[a + i] == words[b + i]
    return same


def judge(table: pa.Table) -> list[tuple[int, int, int, int]]:
    """Of a bucket's super-k-mers, those runs of windows that a smaller document has too: doc_id, text_hash, start, windows."""
    # the same string comes from many batches: its smallest document stands for all, the rest are known at once
    doc, text_hash, start = (table.column(c).to_numpy() for c in "dhs")
    k = table.column("k").to_numpy().astype(np.int64)
    coded = table.column("t").combine_chunks().dictionary_encode()
    string = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, string, doc)
    kk = np.zeros(len(distinct), np.int64)
    kk[string] = k
    words = pc.split_pattern(distinct, " ").flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    lengths = kk + WINDOW - 1
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    # windows of all distinct strings
    owner = np.repeat(np.arange(len(distinct)), kk)
    offset = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(kk)[:-1]]), kk)
    place = begin[owner] + offset
    h = rolled(words.astype(np.uint64), WINDOW)[place]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    at = np.flatnonzero(same)
    if not _equal(words, place[order[at]], place[order[at + 1]]).all():
        # one hash for different words: sort by the words too
        order = np.lexsort([*(words[place + i] for i in reversed(range(WINDOW))), h])
        same = h[order][1:] == h[order][:-1]
        at = np.flatnonzero(same)
        same[at] = _equal(words, place[order[at]], place[order[at + 1]])
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    smallest = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, least[owner[order]])
    first = np.empty(len(order), np.int64)
    first[order] = smallest[group]  # smallest document of each window
    begin_w = np.concatenate([[0], np.cumsum(kk)[:-1]])
    found: list[tuple[int, int, int, int]] = []
    # a row of a larger document than its string's smallest is known whole; others window by window
    high = np.maximum.reduceat(first, begin_w) if len(first) else first
    low = np.minimum.reduceat(first, begin_w) if len(first) else first
    for r in np.flatnonzero(low[string] < doc).tolist():
        g = string[r]
        if high[g] < doc[r]:
            runs = [(int(start[r]), int(k[r]))]
        else:
            flags = first[begin_w[g] : begin_w[g] + kk[g]] < doc[r]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            runs = [(int(start[r] + a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        found += [(int(doc[r]), int(text_hash[r]), a, n) for a, n in runs]
    return found


def dedupe_text(text: str | None, starts: list[int], counts: list[int]) -> tuple[int, int, str]:
    """Number of words, of removed words, and the kept words joined by a space; runs of known windows are given."""
    words = WORD.findall(text or "")
    if not len(starts):
        return len(words), 0, " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.asarray(starts) + np.asarray(counts) + WINDOW - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    return len(words), int(gone.sum()), " ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def known_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text_hash, starts, counts: runs of windows that a smaller document has. docs: doc_id, text_hash, text."""

    parts = min(buckets, MOST_PARTS)  # a task goes through its buckets in turn
    frequent = frequent_slots(docs, parts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack(batches, buckets, buckets, frequent)

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
        now, held = None, []
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and bucket != now:
                    yield now, held
                    held = []
                if bucket < 0:
                    yield bucket, [data]
                else:
                    now = bucket
                    held.append(data)
        if held:
            yield now, held

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, packs in by_bucket(batches):
            if bucket < 0:
                yield _blobs([(-1 - bucket, packs[0])])
            elif known := judge(pa.concat_tables(map(from_bytes, packs))):
                yield _blobs(list(_sharded(known, buckets)))
        trim()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, packs in by_bucket(batches):
            yield gather(list(map(from_bytes, packs)))

    ddl = "bucket int, packed binary"
    sent = docs.filter("doc_id is not null and text is not null").mapInArrow(packed, ddl)
    # what is known at once only passes through; its hash deals it out evenly
    deal = F.when(F.col("bucket") < 0, F.abs(F.hash("packed")) % buckets).otherwise(F.col("bucket"))
    met = sent.repartitionById(parts, deal).sortWithinPartitions("bucket").mapInArrow(judged, ddl)
    return met.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(gathered, RUNS_DDL)


#: Estimates from here on aren't ones: Spark doesn't know the size of what isn't read from files.
UNKNOWN_BYTES = 1 << 55


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """Spark's own estimate of a frame's bytes, from its files' sizes; measured where there is none."""
    told = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if told < UNKNOWN_BYTES:
        return told
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


RESULT = "struct<n_words: bigint, n_removed: bigint, kept: string>"


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """key, n_words, n_removed, kept for each row of docs: the words left once known windows are cut.

    A word goes if a window over it also begins in a document with a smaller key. Nulls: a null text has no
    words; a row with a null key keeps all its words and makes nothing known. Rows of one key don't make
    each other known, so repeated rows stay alike. Texts of fewer than 13 words have no window. Other columns
    are not read. An empty table gives an empty result. Texts are taken whole.
    """
    ready(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    if buckets is None:
        buckets = max(12, -(-input_bytes(slim) // BUCKET_BYTES))
    runs = known_runs(slim, buckets)

    @F.arrow_udf(RESULT)
    def cut(texts: pa.Array, starts: pa.Array, counts: pa.Array) -> pa.Array:
        rows = [dedupe_text(t, s or [], n or []) for t, s, n in zip(texts.to_pylist(), starts.to_pylist(), counts.to_pylist(), strict=True)]
        n, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept"])

    joined = slim.join(runs, ["doc_id", "text_hash"], "left")
    return joined.select(F.col("doc_id").alias(key), cut("text", "starts", "counts").alias("_c")).select(key, "_c.n_words", "_c.n_removed", "_c.kept")


def brute(docs: pd.DataFrame) -> dict[int, tuple[int, int, str]]:
    """The same, window by window, for tests: doc_id to n_words, n_removed, digest of the kept words."""
    first: dict[tuple[str, ...], int] = {}
    words = {d: WORD.findall(t or "") for d, t in zip(docs.doc_id, docs.text, strict=True)}
    for d, ws in words.items():
        for i in range(len(ws) - WINDOW + 1):
            w = tuple(ws[i : i + WINDOW])
            first[w] = min(d, first.get(w, d))
    out = {}
    for d, ws in words.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - WINDOW + 1):
            if first[tuple(ws[i : i + WINDOW])] < d:
                gone[i : i + WINDOW] = [True] * WINDOW
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out[d] = len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


# The same window by window, for DuckDB.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT gram, min(doc_id) AS first FROM grams GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM grams JOIN firsts USING (gram), (SELECT unnest(range(0, 13)) AS o) WHERE first < doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
