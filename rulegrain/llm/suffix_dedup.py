"""Suffix-array dedup: bytes that a string of 100 bytes covers which begins earlier too.

A window is 100 consecutive bytes of one document; its minimiser is its run of 32 bytes with the smallest hash.
Consecutive windows with one minimiser form a stretch. Equal windows have equal minimisers, so:

1. Hashes of all stretches' minimisers are sent, a few bytes each; a stretch whose minimiser is nowhere else
   has no window that is anywhere else, and is done with.
2. The other stretches travel as strings to the bucket of their minimiser. Of equal strings the earliest stands
   for all. Different strings with one minimiser are joined in the order of their places, and suffix order, with
   previous and next smaller positions in it, gives each window's longest previous factor: how long the longest
   string is that begins there and earlier too. Windows with 100 bytes are later copies.
3. Later copies' places go back to their documents, where they are cut.

Map tasks tell at once what they find among their own rows: of a minimiser or a string that a third of all
documents share, each task sends one. Minimisers of very many different windows, told from a sample, come after
all others, so no bucket holds much more than its share; this moves windows, and changes no result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, trim
from .substring_dedup import RUNS_DDL, _blobs, _sharded, from_bytes, gather, input_bytes, mixed, to_bytes

#: Bytes of a window (the contract's), and of a minimiser.
LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Input bytes for which there is one bucket, of minimisers and of strings.
MARK_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20
#: Tasks that buckets are dealt to, at most, and buckets of one task.
MOST_PARTS, DEEP = 100_000, 8
#: Bytes that are hashed at once; bytes of a text at once; stretches, and bytes of strings, that a map task holds before it sends.
BATCH, SLICE, HELD, HELD_BYTES = 1 << 18, 4 << 20, 1 << 18, 8 << 20
#: Frequent minimisers are looked for among this many slots, in one of SAMPLED documents; one is frequent with more than FREQUENT of a task's mean windows, and CROWDED of a slot's.
SLOTS, SAMPLED, FREQUENT, CROWDED = 1 << 18, 16, 0.25, 16

MULTIPLIERS = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)))  # fixed odd numbers
HIGH = np.uint64(1 << 63)
BLOB_DDL = "bucket int, packed binary"


def gram_hashes(data: bytes, frequent: np.ndarray) -> np.ndarray:
    """Of each run of GRAM bytes a hash of 63 bits, and above it whether it is frequent."""
    h = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)) * MULTIPLIERS[0]
    h ^= h >> np.uint64(32)
    for i, half in ((1, 8), (2, 16)):
        h = h[:-half] * MULTIPLIERS[i] + h[half:]
        h ^= h >> np.uint64(29)
    h *= MULTIPLIERS[3]
    h ^= h >> np.uint64(32)
    h >>= np.uint64(1)
    return h | frequent[slot_of(h)].astype(np.uint64) << np.uint64(63) if frequent.any() else h


def slot_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def minima(h: np.ndarray) -> np.ndarray:
    """The smallest of each SPAN values."""
    width = 1
    while 2 * width <= SPAN:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = SPAN - width
    return np.minimum(h[: len(h) - rest], h[rest:])


def stretches(data: bytes, lengths: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' bytes end to end, LENGTH at least each: where stretches of windows begin, their windows, minimisers and texts, and whether a minimiser is there twice."""
    h = gram_hashes(data, frequent)
    low = minima(h)
    ends = np.cumsum(lengths)
    real, first = np.ones(len(low), bool), np.ones(len(low), bool)
    np.not_equal(low[1:], low[:-1], out=first[1:])
    for end in ends[:-1].tolist():  # windows that reach over a text's end aren't windows
        real[end - LENGTH + 1 : end] = False
        first[end] = True
    starts = np.flatnonzero(first & real)
    own = np.searchsorted(ends, starts, side="right")
    until = np.minimum(np.append(starts[1:], len(low)), ends[own] - LENGTH + 1)
    # the next window has lost this place of the minimiser, and still has the minimiser
    again = np.flatnonzero((h[: len(low) - 1] == low[:-1]) & ~first[1:])
    twice = np.zeros(len(starts), bool)
    twice[np.searchsorted(starts, again, side="right") - 1] = True
    return starts, until - starts, low[starts], own, twice


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], bytes, np.ndarray]]:
    """Rows (doc_id, text_hash, text, ...) in batches: of each piece (doc_id, text_hash, bytes before it, row's other columns), all bytes, and the pieces' lengths."""
    todo: list[tuple] = []
    parts: list[bytes] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            b = batch.slice(at, 128)
            texts = b.column(2).cast(pa.binary()).to_pylist()
            for doc, text_hash, text, *rest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, *(b.column(i).to_pylist() for i in range(3, b.num_columns)), strict=True):
                if doc is None or text is None or len(text) < LENGTH or None in rest:
                    continue
                for before in range(0, len(text) - LENGTH + 1, SLICE):
                    part = text[before : before + SLICE + LENGTH - 1]
                    todo.append((doc, text_hash, before, *rest))
                    parts.append(part)
                    size += len(part)
                    if size >= BATCH:
                        yield todo, b"".join(parts), np.array([len(p) for p in parts])
                        todo, parts, size = [], [], 0
    if todo:
        yield todo, b"".join(parts), np.array([len(p) for p in parts])


def _places(todo: list[tuple], lengths: np.ndarray, starts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, text_hash and place in its text of each start."""
    doc, text_hash, before = (np.array([x[i] for x in todo], np.int64) for i in range(3))
    return doc[own], text_hash[own], before[own] + starts - (np.cumsum(lengths) - lengths)[own]


def frequent_slots(docs: DataFrame, parts: int) -> np.ndarray:
    """For each slot whether its minimisers come last, by a sample of documents; SLOTS numbers at most come to the driver."""
    none = np.zeros(SLOTS, bool)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for _, data, lengths in pieces(batches):
            _, k, low, *_ = stretches(data, lengths, none)
            n += np.bincount(slot_of(low), k, SLOTS).astype(np.int64)
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(n[slot], pa.int64())], names=["slot", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SAMPLED)) == 0)
    told = sample.select("doc_id", "text_hash", "text").mapInArrow(tally, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = told.column("slot").to_numpy(), told.column("n").to_numpy()
    found = none.copy()
    found[slot[n > n.sum() * max(FREQUENT / parts, CROWDED / SLOTS)]] = True
    return found


def pack_marks(mark: np.ndarray, doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray) -> bytes:
    """Marks by document, in few bytes; places are sorted by document."""
    new = np.diff(doc, prepend=doc[:1] - 1) != 0
    new[1:] |= text_hash[1:] != text_hash[:-1]
    ids = np.diff(doc[new], prepend=0)
    parts = (mark.astype("<u4"), start.astype("<i4"), new.view(np.uint8), ids.astype("<i8"), text_hash[new].astype("<i8"))
    return struct.pack("<II", len(mark), len(ids)) + zstandard.compress(b"".join(p.tobytes() for p in parts))


def unpack_marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = struct.unpack_from("<II", data)
    raw = zstandard.decompress(data[8:])
    mark, start = np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<i4", n, 4 * n)
    own = np.cumsum(np.frombuffer(raw, np.uint8, n, 8 * n).astype(np.int64)) - 1
    ids, hashes = np.cumsum(np.frombuffer(raw, "<i8", m, 9 * n)), np.frombuffer(raw, "<i8", m, 9 * n + 8 * m)
    return mark, ids[own], hashes[own], start


def _split(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of a sorted array: value, begin, end."""
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, j in zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist(), strict=True):
        yield int(bucket[i]), i, j


def marks(batches: Iterator[pa.RecordBatch], buckets: int, shards: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text_hash, text) to marks of minimisers by bucket; places of those found twice here go to their shard (bucket -1 - shard), and a mark without a place."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def told() -> pa.RecordBatch:
        low, doc, text_hash, start, twice = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(low, kind="stable")
        low, doc, text_hash, start = low[order], doc[order], text_hash[order], start[order]
        first = np.diff(low, prepend=~low[:1]) != 0
        alone = first & np.append(first[1:], True) & ~twice[order]
        again = ~alone
        out = [(-1 - s, x) for s, x in _sharded(np.stack([doc[again], text_hash[again], start[again], np.zeros(again.sum(), np.int64)], axis=1), shards)]
        some = first & again
        doc, text_hash, start = (np.where(alone, x, fill)[alone | some] for x, fill in ((doc, 0), (text_hash, 0), (start, -1)))
        low = low[alone | some]
        bucket = (low % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((start, text_hash, doc, bucket))
        mark = (low >> np.uint64(8) & np.uint64(0xFFFFFFFF))[order]
        doc, text_hash, start = doc[order], text_hash[order], start[order]
        return _blobs(out + [(b, pack_marks(mark[i:j], doc[i:j], text_hash[i:j], start[i:j])) for b, i, j in _split(bucket[order])])

    for todo, data, lengths in pieces(batches):
        starts, _, low, own, twice = stretches(data, lengths, frequent)
        held.append((low, *_places(todo, lengths, starts, own), twice))
        size += len(low)
        if size >= HELD:
            yield told()
            held, size = [], 0
    if held:
        yield told()
    held.clear()
    trim()


def repeated(packs: list[bytes], shards: int) -> pa.RecordBatch | None:
    """Places of the marks of a bucket that are there twice, by shard."""
    mark, doc, text_hash, start = (np.concatenate(x) for x in zip(*map(unpack_marks, packs), strict=True))
    order = np.argsort(mark, kind="stable")
    same = mark[order][1:] == mark[order][:-1]
    twice = np.zeros(len(mark), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= start >= 0
    if not twice.any():
        return None
    return _blobs([(s, x) for s, x in _sharded(np.stack([doc[twice], text_hash[twice], start[twice], np.zeros(twice.sum(), np.int64)], axis=1), shards)])


def strings(batches: Iterator[pa.RecordBatch], buckets: int, shards: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text_hash, text, starts) to the stretches that begin there, by bucket; runs of windows known at once go to their shard."""
    held: list[tuple[np.ndarray, ...]] = []
    texts: list[bytes] = []
    size = 0

    def told() -> pa.RecordBatch:
        low, doc, text_hash, start, k = (np.concatenate(x) for x in zip(*held, strict=True))
        string = pa.array(texts, pa.binary())
        code = string.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sent, later = earliest_of(code, doc, text_hash, start)
        out = [(-1 - s, x) for s, x in _sharded(np.stack([doc[later], text_hash[later], start[later], k[later]], axis=1), shards)]
        bucket = (low[sent] % np.uint64(buckets)).astype(np.int64)
        sent, bucket = sent[by := np.lexsort((start[sent], doc[sent], bucket))], bucket[by]
        for b, i, j in _split(bucket):
            o = sent[i:j]
            out.append((b, to_bytes(pa.table({"d": doc[o], "h": text_hash[o], "s": start[o].astype(np.int32), "t": string.take(pa.array(o))}))))
        return _blobs(out)

    for todo, data, lengths in pieces(batches):
        starts, k, low, own, _ = stretches(data, lengths, frequent)
        doc, text_hash, place = _places(todo, lengths, starts, own)
        edge = np.searchsorted(own, np.arange(len(todo) + 1))
        wanted = np.zeros(len(starts), bool)
        for n, x in enumerate(todo):
            here = slice(edge[n], edge[n + 1])
            wanted[here] = np.isin(place[here], np.asarray(x[3], np.int64))
        at = np.flatnonzero(wanted)
        held.append((low[at], doc[at], text_hash[at], place[at], k[at]))
        texts += [data[i:j] for i, j in zip(starts[at].tolist(), (starts[at] + k[at] + LENGTH - 1).tolist(), strict=True)]
        size += int((k[at] + LENGTH - 1).sum())
        if size >= HELD_BYTES:
            yield told()
            held, texts, size = [], [], 0
    if texts:
        yield told()
    held.clear()
    texts.clear()
    trim()


def earliest_of(code: np.ndarray, doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the earliest place of each code, and rows with later places; repeated rows of the earliest place are neither."""
    order = np.lexsort((start, text_hash, doc, code))
    first = np.diff(code[order], prepend=-1) != 0
    earliest = order[first]
    lead = earliest[np.cumsum(first) - 1]
    elsewhere = (doc[order] != doc[lead]) | (text_hash[order] != text_hash[lead]) | (start[order] != start[lead])
    return earliest, order[elsewhere]


def ranked(key: np.ndarray) -> np.ndarray:
    """Dense ranks of values."""
    order = np.argsort(key)
    new = np.diff(key[order], prepend=key[order[:1]]) != 0
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_ranks(data: bytes) -> dict[int, np.ndarray]:
    """Ranks of all strings of 8, 16, 32, 64 and LENGTH bytes in data, by doubling; equal strings have equal ranks."""
    ranks = {8: ranked(np.ndarray((len(data) - 7,), ">u8", data, 0, (1,)).astype(np.uint64))}
    for have, depth in ((8, 16), (16, 32), (32, 64), (64, LENGTH)):
        step = depth - have
        r = ranks[have]
        ranks[depth] = ranked(r[:-step] * (int(r.max()) + 1) + r[step:])
    return ranks


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Of each value the place of the nearest smaller one before it, or -1. Places jump over what is larger, all at once."""
    place = np.arange(-1, len(values) - 1)
    todo = np.arange(len(values))
    while len(todo):
        todo = todo[place[todo] >= 0]
        todo = todo[values[place[todo]] > values[todo]]
        place[todo] = place[place[todo]]
    return place


def common(ranks: dict[int, np.ndarray], data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes strings at a and at b have in common, up to LENGTH."""
    whole = ranks[LENGTH][a] == ranks[LENGTH][b]
    n = np.zeros(len(a), np.int64)
    for depth in (64, 32, 16, 8):
        r, x, y = ranks[depth], a + n, b + n
        inside = (x < len(r)) & (y < len(r))
        n += depth * (inside & (r[np.where(inside, x, 0)] == r[np.where(inside, y, 0)]))
    for _ in range(7):
        x, y = a + n, b + n
        inside = (x < len(data)) & (y < len(data))
        same = inside & (data[np.where(inside, x, 0)] == data[np.where(inside, y, 0)])
        if not same.any():
            break
        n += same  # one that stopped stops again
    return np.where(whole, LENGTH, np.minimum(n, LENGTH))


def previous_factors(data: bytes, at: np.ndarray) -> np.ndarray:
    """Longest previous factors: of each place in at (ascending) how many bytes, up to LENGTH, begin at an earlier place of at too.

    In suffix order the earlier place with most bytes in common is the nearest one before or behind with a smaller position.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    ranks = suffix_ranks(data)
    raw = np.frombuffer(data, np.uint8)
    order = np.argsort(ranks[LENGTH][at], kind="stable")  # equal strings by position
    position = at[order]
    before = previous_smaller(position)
    behind = len(at) - 1 - previous_smaller(position[::-1])[::-1]
    factor = np.zeros(len(at), np.int64)
    for near, there in ((before, before >= 0), (behind, behind < len(at))):
        i = np.flatnonzero(there)
        factor[i] = np.maximum(factor[i], common(ranks, raw, position[i], position[near[i]]))
    out = np.empty(len(at), np.int64)
    out[order] = factor
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def judge(table: pa.Table, frequent: np.ndarray) -> np.ndarray:
    """Of a bucket's stretches the runs of windows that are earlier too: rows doc_id, text_hash, start, windows."""
    doc, text_hash, start = (table.column(c).to_numpy() for c in "dhs")
    coded = table.column("t").combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    earliest, later = earliest_of(code, doc, text_hash, start)
    texts = coded.dictionary.to_pylist()
    size = np.array([len(t) for t in texts])
    found = [np.stack([doc[later], text_hash[later], start[later], size[code[later]] - LENGTH + 1], axis=1)]

    # distinct strings by their earliest place; those with a minimiser of their own, once in them, are first
    earliest = earliest[np.lexsort((start[earliest], text_hash[earliest], doc[earliest]))]
    texts, size = [texts[c] for c in code[earliest].tolist()], size[code[earliest]]
    data = b"".join(texts)
    begin = np.cumsum(size) - size
    h = gram_hashes(data, frequent)
    ends = begin + size
    over = (ends[:-1, None] - GRAM + 1 + np.arange(GRAM - 1)).ravel()
    h[over] = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.minimum.reduceat(h, begin)
    inner = np.add.reduceat(h == np.repeat(low, np.append(begin[1:], len(h)) - begin), begin)
    _, group, members = np.unique(low, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero((members[group] > 1) | (inner > 1))
    if len(open_):
        data, size = b"".join(texts[i] for i in open_.tolist()), size[open_]
        windows = size - LENGTH + 1
        begin = np.cumsum(size) - size
        own = np.repeat(np.arange(len(open_)), windows)
        offset = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
        known = previous_factors(data, begin[own] + offset) >= LENGTH
        # runs don't go over a string's end
        padded = np.zeros(len(own) + len(open_), bool)
        padded[np.arange(len(own)) + own] = known
        a, b = _runs(padded)
        string = np.searchsorted(np.cumsum(windows + 1), a, side="right")
        row = earliest[open_[string]]
        shift = a - (np.cumsum(windows + 1) - windows - 1)[string]
        found.append(np.stack([doc[row], text_hash[row], start[row] + shift, b - a], axis=1))
    return np.concatenate(found).astype(np.int64)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Packs of each bucket together; what is known already (below 0) comes one by one."""
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


def met(sent: DataFrame, buckets: int, parts: int, judged: Callable[[list[bytes]], pa.RecordBatch | None]) -> DataFrame:
    """doc_id, text_hash, starts, counts: what judged() finds in each bucket and what was known at once, by document."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, packs in by_bucket(batches):
            if bucket < 0:
                yield _blobs([(-1 - bucket, packs[0])])
            elif (found := judged(packs)) is not None:
                yield found
        trim()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, packs in by_bucket(batches):
            yield gather(list(map(from_bytes, packs)))

    # what is known at once only passes through; its hash deals it out evenly
    deal = F.when(F.col("bucket") < 0, F.abs(F.hash("packed")) % parts).otherwise(F.col("bucket") % parts)
    found = sent.repartitionById(parts, deal.cast("int")).sortWithinPartitions("bucket").mapInArrow(told, BLOB_DDL)
    return found.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(gathered, RUNS_DDL)


def cut_text(text: bytes, starts: list[int], counts: list[int]) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and the bytes that are left; runs of later copies are given."""
    if not len(starts):
        return 0, 0, text
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.asarray(starts) + np.asarray(counts) + LENGTH - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    a, _ = _runs(gone)
    return int(gone.sum()), len(a), np.frombuffer(text, np.uint8)[~gone].tobytes()


RESULT = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept: binary>"


def suffix_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", in_bytes: int | None = None) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept for each row of docs: the bytes left once later copies are cut.

    A byte goes if a string of 100 bytes over it begins earlier too: in a row with a smaller key, or in the same
    text. kept is binary, as cuts may go through a character. Nulls: a null text is empty; a row with a null key
    keeps all its bytes and makes nothing a later copy. Rows with equal keys and texts are one document, so
    repeated rows stay alike; rows with one key and different texts are different documents, in the order of
    their texts' hashes. Texts of fewer than 100 bytes have no window. Other columns are not read. An empty
    table gives an empty result. Texts are taken whole. in_bytes: the texts' bytes, if known.
    """
    ready(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    size = input_bytes(slim) if in_bytes is None else in_bytes
    marked = min(MOST_PARTS, max(12, -(-size // MARK_BYTES)))
    buckets = min(MOST_PARTS * DEEP, max(12, -(-size // BUCKET_BYTES)))
    parts = min(MOST_PARTS, buckets)
    frequent = frequent_slots(slim, parts)

    def send_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return marks(batches, marked, marked, frequent)

    def send_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return strings(batches, buckets, parts, frequent)

    def judged(packs: list[bytes]) -> pa.RecordBatch | None:
        known = judge(pa.concat_tables(map(from_bytes, packs)), frequent)
        return _blobs(list(_sharded(known, parts))) if len(known) else None

    keys = ["doc_id", "text_hash"]
    again = met(slim.mapInArrow(send_marks, BLOB_DDL), marked, marked, lambda packs: repeated(packs, marked)).select(*keys, "starts")
    # both joins send the texts alike, so Spark sends them once
    runs = met(slim.join(again, keys, "left").select(*keys, "text", "starts").mapInArrow(send_strings, BLOB_DDL), buckets, parts, judged)

    @F.arrow_udf(RESULT)
    def cut(texts: pa.Array, starts: pa.Array, counts: pa.Array) -> pa.Array:
        whole = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        rows = [cut_text(t, s or [], n or []) for t, s, n in zip(whole, starts.to_pylist(), counts.to_pylist(), strict=True)]
        gone, spans, kept = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(map(len, whole), pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["n_bytes", "n_removed", "n_spans", "kept"])

    joined = slim.join(runs, keys, "left")
    return joined.select(F.col("doc_id").alias(key), cut("text", "starts", "counts").alias("_c")).select(key, "_c.*")


def brute(docs: pd.DataFrame) -> dict[int, tuple[int, int, int, str]]:
    """The same, window by window, for tests: doc_id to n_bytes, n_removed, n_spans, digest of the kept bytes."""
    texts = {d: (t or "").encode() for d, t in zip(docs.doc_id, docs.text, strict=True)}
    seen: set[bytes] = set()
    out = {}
    for d in sorted(texts):
        data = texts[d]
        gone = bytearray(len(data))
        for i in range(len(data) - LENGTH + 1):
            if (w := data[i : i + LENGTH]) in seen:
                gone[i : i + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


# The same window by window, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
b AS (SELECT doc_id, x, unnest(range(1, octet_length(x) + 1)) AS i FROM d),
w AS (SELECT doc_id, i, array_slice(x, i, i) AS byte, CASE WHEN i + 99 <= octet_length(x) THEN array_slice(x, i, i + 99) END AS s FROM b),
firsts AS (SELECT s, min(doc_id::HUGEINT * 4294967296 + i) AS place FROM w WHERE s IS NOT NULL GROUP BY 1),
f AS (SELECT doc_id, i, byte, place < doc_id::HUGEINT * 4294967296 + i AS later FROM w LEFT JOIN firsts USING (s)),
g AS (SELECT doc_id, i, byte, coalesce(max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), false) AS gone FROM f),
e AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS begins FROM g),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(CASE WHEN gone THEN '' ELSE hex(byte) END, '' ORDER BY i) AS kept FROM e GROUP BY 1)
SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
