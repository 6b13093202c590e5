"""N-gram Jaccard join by T-occurrence search with DivideSkip, and its components.

Two sets of sizes n and m with Jaccard similarity of 3/4 or more share T = ceil(3 (n + m) / 7) shingles, and
each has at least 3/4 of its shingles in the other. Whatever links two sets is found by one search,
occurrences(): of a set's inverted lists the longest are left aside, the short ones are merged with a heap, and
the candidates on enough of them are looked up in the long lists by binary search, until T is reached or out
of reach. The join goes through ever fewer documents:

1. Every document's set, as 64-bit hashes, is made where its text lies. Hashes under a threshold go to
   buckets, which tell in how many of them a document isn't alone. Documents with too many lonely ones have
   no partner. Equal sets become one class.
2. In rounds, classes with a common minimum hash meet in parts of bounded size. There each class searches the
   lists of the leaders so far; it joins those that it finds, or becomes a leader. Only leaders go on to the
   next round. So a group of near copies, however large, becomes one cluster without pairs inside the group.
3. What can still link are classes of different clusters. A shingle that only one cluster has can't help,
   so each class keeps those of several, and classes that have enough of them left search each other's lists.

All links between classes of different clusters are found, so the components are exact (up to equal 64-bit
hashes of different shingles).
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, join_hot, ready, table, trim
from .components import components
from .substring_dedup import MOST_PARTS, codes_of, from_bytes, input_bytes, mixed, rolled, to_bytes

SHINGLE = 5
#: Similarity, in hundredths.
PERCENT = 75
WORD = re.compile(WORD_PATTERN)
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Share of all hashes that the first filter looks at.
SAMPLED = 0.4
#: Input bytes for which the first filter has a bucket; tokens of classes for which later steps have one.
BUCKET_BYTES, BUCKET_TOKENS = 16 << 20, 4_000_000
#: Words that a map task turns into sets at once, and tokens of one block of classes.
BATCH_WORDS, BLOCK_TOKENS = 500_000, 200_000
ROUNDS = 3
ALONE = 0xFFFF


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n shares with any partner, at least."""
    return -(-n * PERCENT // 100)


def pair_overlap(n: int, m: int) -> int:
    """Shingles that sets of n and m must share: the smallest i with 100 i >= PERCENT (n + m - i)."""
    return -(-(n + m) * PERCENT // (100 + PERCENT))


#: Members of merged lists up to which they are merged by a heap; more are sorted.
HEAP_MEMBERS = 512


def occurrences(n: int, lists: list[Sequence[int]], sizes: Sequence[int], wanted: Callable[[int], bool], begin: int = 0, end: int | None = None) -> Iterator[int]:
    """T-occurrence search by DivideSkip: positions from begin to end on T of a set's inverted lists, T by the set's size n and theirs.

    lists are those of the set's tokens that others have, each in order. Any partner is on least_overlap(n)
    of them, so on one of the short lists if one fewer are left aside.
    """
    aside = least_overlap(n) - 1
    if len(lists) <= aside:
        return
    lists.sort(key=len)
    cut = len(lists) - aside
    short = [x if not begin and end is None else x[bisect_left(x, begin) : len(x) if end is None else bisect_left(x, end)] for x in lists[:cut]]
    if sum(map(len, short)) <= HEAP_MEMBERS:
        merged = ((q, sum(1 for _ in same)) for q, same in groupby(heapq.merge(*[x for x in short if x])))
    else:
        merged = zip(*(x.tolist() for x in np.unique(np.concatenate([np.array(x, np.int64) for x in short]), return_counts=True)), strict=True)
    for q, have in merged:
        need, left = pair_overlap(n, sizes[q]), aside
        if have + left < need or need > min(n, sizes[q]) or not wanted(q):
            continue
        for x in lists[cut:]:
            if have >= need or have + left < need:
                break
            at = bisect_left(x, q)
            have += at < len(x) and x[at] == q
            left -= 1
        if have >= need:
            yield q


def shared_tokens(sets: list[np.ndarray]) -> list[list[int]]:
    """Of each set the tokens that another one has too."""
    every = np.sort(np.concatenate(sets))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    if not len(twice):
        return [[] for _ in sets]
    return [s[twice[np.searchsorted(twice, s).clip(max=len(twice) - 1)] == s].tolist() for s in sets]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def sets_of(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    words = [WORD.findall(t.translate(LOWER) if not t.islower() else t) for t in texts]
    codes, distinct = codes_of([w for ws in words for w in ws])
    h = word_hashes(distinct)[codes] if len(distinct) else np.zeros(0, np.uint64)
    out, at = [], 0
    for ws in words:
        n, own = len(ws), h[at : at + len(ws)]
        at += n
        out.append(np.unique(rolled(own, min(n, SHINGLE))) if n else np.zeros(0, np.uint64))
    return out


def _batched(batches: Iterator[pa.RecordBatch], text: int, chars: int = BATCH_WORDS * 6) -> Iterator[list[tuple]]:
    todo, size = [], 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            todo.append(row)
            size += len(row[text] or "")
            if size >= chars:
                yield todo
                todo, size = [], 0
    if todo:
        yield todo
    del todo
    trim()


BLOBS = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
BLOBS_DDL = "bucket int, packed binary"


def _blobs(rows: list[tuple[int, pa.Table]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([to_bytes(t) for _, t in rows], pa.binary())], schema=BLOBS)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Table]]]:
    """Buckets of a task, in order, with their tables; tables of no bucket (-1) come one by one."""
    now, held = None, []
    for b in batches:
        for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if held and bucket != now:
                yield now, list(map(from_bytes, held))
                held = []
            if bucket < 0:
                yield -1, [from_bytes(data)]
            else:
                now = bucket
                held.append(data)
    if held:
        yield now, list(map(from_bytes, held))
    trim()


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    """Blobs by bucket, each task's buckets in order; those of no bucket anywhere."""
    deal = F.when(F.col("bucket") < 0, F.abs(F.hash("packed")) % buckets).otherwise(F.col("bucket"))
    return df.repartitionById(min(buckets, MOST_PARTS), deal).sortWithinPartitions("bucket")


# ---- 1: which documents can have a partner

SAMPLES = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("set_id", pa.string()), ("n", pa.int64()), ("sampled", pa.int64()), ("shared", pa.int64()), ("rows", pa.int64())])
SAMPLES_DDL = "node bigint, doc_id bigint, set_id string, n bigint, sampled bigint, shared bigint, rows bigint"


def sample(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, doc_id, text) to blobs: sampled hashes by bucket, and each node's own figures in bucket -1."""
    top = np.uint64(int(SAMPLED * 2**64))
    edges = np.array([int(SAMPLED * 2**64) * i // buckets for i in range(buckets)], np.uint64)
    shift = np.uint64(max(0, (int(SAMPLED * 2**64) // buckets).bit_length() - 40))
    for rows in _batched(batches, 2):
        sets = sets_of([r[2] or "" for r in rows])
        ids = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
        small = [s[: np.searchsorted(s, top)] for s in sets]
        seen: set[str] = set()
        sends = [i for i, x in enumerate(ids) if x is not None and rows[i][1] is not None and not (x in seen or seen.add(x))]
        h = np.concatenate([small[i] for i in sends] or [np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sends)), [len(small[i]) for i in sends])
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        alone = first & np.concatenate([first[1:], [True]]) if len(h) else first
        known = np.bincount(owner[~alone], minlength=len(sends))
        h, who = h[first], np.where(alone, owner, -1)[first]
        cut = np.searchsorted(h, edges)
        out = []
        for b, (i, j) in enumerate(zip(cut, [*cut[1:], len(h)], strict=True)):
            if i == j:
                continue
            v = (h[i:j] - edges[b]) >> shift
            mine, local = np.unique(who[i:j], return_inverse=True)  # -1 comes first
            out.append((b, pa.table({
                "high": pa.array([np.diff(v >> np.uint64(8), prepend=np.uint64(0)).astype(np.uint32)], pa.list_(pa.uint32())), "low": pa.array([(v & np.uint64(255)).astype(np.uint8)], pa.list_(pa.uint8())),
                "local": pa.array([local.astype(np.uint32)], pa.list_(pa.uint32())), "node": pa.array([[rows[sends[k]][0] if k >= 0 else None for k in mine]], pa.list_(pa.int64())),
            })))
        sent = dict(zip(sends, known.tolist(), strict=True))
        own = pa.table({
            "node": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "set_id": pa.array(ids, pa.string()), "n": pa.array([len(s) for s in sets], pa.int64()),
            "sampled": pa.array([len(s) for s in small], pa.int64()), "shared": pa.array([sent.get(i, 0) for i in range(len(rows))], pa.int64()), "rows": pa.array([1] * len(rows), pa.int64()),
        })
        yield _blobs([*out, (-1, own)])


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs to rows of SAMPLES: for each node how many of its hashes another batch has too."""
    for bucket, tables in _by_bucket(batches):
        if bucket < 0:
            yield from tables[0].cast(SAMPLES).to_batches()
            continue
        values, nodes = [], []
        for t in tables:
            high, low, local = (t.column(c).chunks[0].values.to_numpy() for c in ("high", "low", "local"))
            node = t.column("node").chunks[0].values
            real = np.asarray(node.fill_null(0))
            values.append(np.cumsum(high, dtype=np.uint64) << np.uint64(8) | low)
            nodes.append((real[local], ~np.asarray(node.is_null())[local]))
        v = np.concatenate(values)
        who, counts = (np.concatenate([x[i] for x in nodes]) for i in (0, 1))
        order = np.argsort(v, kind="stable")
        v = v[order]
        same = v[1:] == v[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        hits = who[order][shared & counts[order]]
        node, n = np.unique(hits, return_counts=True)
        zero = pa.array(np.zeros(len(node), np.int64))
        empty = pa.nulls(len(node), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), empty, pa.nulls(len(node), pa.string()), zero, zero, pa.array(n, pa.int64()), zero], schema=SAMPLES)


def figures(slim: DataFrame, buckets: int) -> DataFrame:
    """node, doc_id, set_id, n, sampled, shared, rows: of each distinct row; shared counts sampled hashes that others have too."""
    sent = slim.mapInArrow(lambda it: sample(it, buckets), BLOBS_DDL)
    met = _dealt(sent, buckets).mapInArrow(meet, SAMPLES_DDL)
    return met.groupBy("node").agg(
        F.max("doc_id").alias("doc_id"), F.max("set_id").alias("set_id"), F.max("n").alias("n"), F.max("sampled").alias("sampled"),
        F.sum("shared").alias("shared"), F.sum("rows").alias("rows"),
    )


# ---- 2: classes and clusters

CLASSES = "id bigint, lonely double, n bigint, tokens binary, " + ", ".join(f"k{i} bigint" for i in range(ROUNDS))


def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, lonely, text) to classes: size, tokens, and a minimum hash for each round."""
    for rows in _batched(batches, 2):
        sets = sets_of([r[2] or "" for r in rows])
        keys = [[int(mixed(s ^ np.uint64(0x5851F42D4C957F2D * (i + 1) % 2**64)).min().view(np.int64)) for s in sets] for i in range(ROUNDS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), *(pa.array(k, pa.int64()) for k in keys)],
            names=["id", "lonely", "n", "tokens", *(f"k{i}" for i in range(ROUNDS))],
        )


#: Tokens of classes that meet in a task; classes of one key that have more are dealt into parts. Keys that are told to all tasks, at most:
#: fewer have more than that part of all tokens, and keys with less than that aren't dealt.
TOGETHER, MOST_LARGE = 500_000, 1_000_000


def large_keys(df: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """key, parts of the keys whose classes are too many to meet at once."""
    least = max(TOGETHER, total // MOST_LARGE)
    return F.broadcast(df.groupBy(key).agg(F.sum(n).alias("parts")).filter(F.col("parts") > least).withColumn("parts", F.ceil(F.col("parts") / TOGETHER).cast("int")))


def led(rows: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Pairs (id, leader's id) of the classes that aren't leaders. Each class searches the lists of the leaders before it; it leads itself if it finds none."""
    sizes: list[int] = []
    leaders: list[int] = []
    to: list[int] = []
    lists: dict[int, list[int]] = {}

    def top(i: int) -> int:
        while to[i] != i:
            to[i] = i = to[to[i]]
        return i

    joined: list[tuple[int, int]] = []
    for (own, tokens), shared in zip(rows, shared_tokens([t for _, t in rows]), strict=True):
        first: int | None = None
        # one of each group of joined leaders is enough
        for q in occurrences(len(tokens), [lists[x] for x in shared if x in lists], sizes, lambda q: first is None or top(q) != top(first)):
            if first is None:
                first = q
            else:
                a, b = top(first), top(q)
                to[max(a, b)] = min(a, b)
        if first is not None:
            joined.append((own, first))
            continue
        for x in shared:
            lists.setdefault(x, []).append(len(leaders))
        to.append(len(leaders))
        leaders.append(own)
        sizes.append(len(tokens))
    yield from ((own, leaders[top(q)]) for own, q in joined)
    yield from ((own, leaders[top(i)]) for i, own in enumerate(leaders) if to[i] != i)


def meet_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, id, tokens), key by key and part by part, to pairs (id, leader's id)."""
    now, rows = None, []

    def done() -> pa.RecordBatch:
        found = list(led(rows)) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for key, part, own, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (key, part) != now:
                if len(rows) > 1:
                    yield done()
                now, rows = (key, part), []
            rows.append((own, np.frombuffer(tokens, np.uint64)))
    yield done()
    trim()


def clustered(classes: DataFrame, total: int, tokens: int, buckets: int) -> DataFrame:
    """id, cluster, by rounds of searches among classes with a common minimum hash.

    In a part, classes with the smallest share of shingles that nobody else has come first, and lead: of near
    copies they are closest to what the others were copied from, and so to all others.
    """
    heads = classes.select("id", "lonely", "n", *(f"k{i}" for i in range(ROUNDS)))
    found = None
    for i in range(ROUNDS):
        key = f"k{i}"
        dealt = heads.select("id", "lonely", key).join(large_keys(heads, key, "n", tokens), key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0)))
        rows = dealt.join(classes.select("id", "tokens"), "id").repartition(buckets, key, "part").sortWithinPartitions(key, "part", "lonely", "id")
        links = table(rows.select(key, "part", "id", "tokens").mapInArrow(meet_leaders, "a bigint, b bigint"), "led")
        heads = heads.join(links.select(F.col("a").alias("id")), "id", "left_anti")
        step = links.select(F.col("a").alias("cluster"), F.col("b").alias("to"))
        if found is None:
            found = links.select(F.col("a").alias("id"), F.col("b").alias("cluster"))
        else:
            sizes = found.groupBy("cluster").agg(F.count("*").alias("_rows"))
            moved = join_hot(found, step.join(sizes, "cluster"), "cluster", total, "id").select("id", F.coalesce("to", "cluster").alias("cluster"))
            found = moved.unionByName(step.select(F.col("cluster").alias("id"), F.col("to").alias("cluster")))
    return table(classes.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")), "clusters")


# ---- 3: links between clusters

def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, cluster, n, tokens) to blocks of them."""
    def emit(rows: list[tuple]) -> pa.RecordBatch:
        t = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "cluster": pa.array([r[1] for r in rows], pa.int64()), "tokens": pa.array([r[3] for r in rows], pa.large_binary())})
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int64()), pa.array([to_bytes(t)], pa.binary())], names=["block", "packed"])

    todo, size = [], 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            todo.append(row)
            size += row[2]
            if size >= BLOCK_TOKENS:
                yield emit(todo)
                todo, size = [], 0
    if todo:
        yield emit(todo)


def unblock(data: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    t = from_bytes(data)
    return t.column("id").to_numpy(), t.column("cluster").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]


def _cut(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """Bucket, begin and end in sorted hashes."""
    edges = np.array([(2**64 * i) // buckets for i in range(buckets)], np.uint64)
    cut = np.searchsorted(h, edges).tolist()
    return [(b, i, j) for b, (i, j) in enumerate(zip(cut, [*cut[1:], len(h)], strict=True)) if j > i]


def ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks to questions by bucket: each token once, with its classes' number and the cluster, if there is but one."""
    for b in batches:
        for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            _, cluster, sets = unblock(data)
            h, c = np.concatenate(sets), np.repeat(cluster, [len(s) for s in sets])
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            low, high = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
            n, token = np.diff(np.append(at, len(h))), h[at]
            yield _blobs([
                (k, pa.table({"token": token[i:j], "n": n[i:j], "cluster": low[i:j], "several": low[i:j] != high[i:j], "block": np.full(j - i, block)})) for k, i, j in _cut(token, buckets)
            ])


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions to (block, tokens of several clusters, their lists' lengths, the smallest cluster of each list)."""
    for _, tables in _by_bucket(batches):
        t = pa.concat_tables(tables)
        token, n, cluster, several, block = (t.column(c).to_numpy() for c in ("token", "n", "cluster", "several", "block"))
        order = np.argsort(token, kind="stable")
        h, c = token[order], cluster[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(at, len(h)))
        first = np.minimum.reduceat(c, at)
        mixed_ = (first != np.maximum.reduceat(c, at)) | np.logical_or.reduceat(several[order], at)
        total = np.add.reduceat(n[order], at)
        keep = np.repeat(mixed_, size)
        if not keep.any():
            continue
        h, total, label, who = h[keep], np.repeat(total, size)[keep], np.repeat(first, size)[keep], block[order][keep]
        by = np.argsort(who, kind="stable")
        ids, begin = np.unique(who[by], return_index=True)
        ends = np.append(begin[1:], len(by))
        told = [x[by] for x in (h, total.astype(np.int64), label)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *(pa.array([x[i:j].tobytes() for i, j in zip(begin, ends, strict=True)], pa.binary()) for x in told)], names=["block", "told", "lengths", "labels"]
        )


LISTED = "label bigint, tokens bigint, packed binary"


def short_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block data, told, lengths, labels) to the classes that can reach T, by the labels of their short lists.

    A list's label is its smallest cluster. Partners are both on a short list, so they meet under its label;
    lists of one family of texts have few labels, so a class goes to few places. It takes its tokens along.
    """
    for b in batches:
        for data, told, lengths, labels in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            ids, cluster, sets = unblock(data)
            token, size, label = np.frombuffer(b"".join(told), np.uint64), np.frombuffer(b"".join(lengths), np.int64), np.frombuffer(b"".join(labels), np.int64)
            order = np.argsort(token, kind="stable")
            token, size, label = token[order], size[order], label[order]
            out: dict[int, list[dict]] = {}
            for i, s in enumerate(sets):
                at = np.searchsorted(token, s).clip(max=len(token) - 1)
                hit = token[at] == s
                m, need = int(hit.sum()), least_overlap(len(s))
                if m < need:
                    continue
                own, at = s[hit], at[hit]
                rank = np.lexsort((own, size[at]))
                short = m - need + 1
                row = {"id": int(ids[i]), "cluster": int(cluster[i]), "n": len(s), "tokens": own.tobytes()}
                for x in np.unique(label[at[rank[:short]]]).tolist():
                    out.setdefault(x, []).append(row)
            rows = [(x, sum(len(y["tokens"]) // 8 for y in r), to_bytes(pa.Table.from_pylist(r))) for x, r in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["label", "tokens", "packed"])


def search(rows: list[dict], sides: list[int]) -> Iterator[tuple[int, int]]:
    """Links that join clusters: pairs of different sides, or of any if there is one side only. Clusters that a link has joined aren't compared again."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["n"], rows[i]["id"]))
    rows, sides = [rows[i] for i in order], [sides[i] for i in order]
    apart = len(set(sides)) > 1
    n = [r["n"] for r in rows]
    tokens = shared_tokens([np.frombuffer(r["tokens"], np.uint64) for r in rows])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    lists: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        for x in t:
            lists.setdefault(x, []).append(i)
    for p, t in enumerate(tokens):
        # partners come after p in order of size, and need at most the shingles that p has among several clusters
        last = bisect_right(n, min(len(t) * (100 + PERCENT) // PERCENT - n[p], n[p] * 100 // PERCENT))
        own = rows[p]["cluster"]
        for q in occurrences(n[p], [lists[x] for x in t], n, lambda q: not (apart and sides[p] == sides[q]) and find(own) != find(rows[q]["cluster"]), p + 1, last):
            root[find(own)] = find(rows[q]["cluster"])
            yield rows[p]["id"], rows[q]["id"]


def meet_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, i, j, side, packed), in order, to links, label by label and pair of parts by pair of parts."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        rows, sides = [], []
        for side, data in held:
            more = from_bytes(data).to_pylist()
            rows += more
            sides += [side] * len(more)
        links = list(search(rows, sides)) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    for b in batches:
        for label, i, j, side, data in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
            if (label, i, j) != now:
                if held:
                    yield done()
                now, held = (label, i, j), []
            held.append((side, data))
    yield done()
    trim()


def across(classes: DataFrame, clusters: DataFrame, buckets: int) -> DataFrame:
    """Similar pairs (a, b) of classes in different clusters: enough of them to join all clusters that links join."""
    with_cluster = classes.select("id", "n", "tokens").join(clusters, "id").select("id", "cluster", "n", "tokens")
    in_order = with_cluster.repartitionByRange(buckets, "cluster", "id").sortWithinPartitions("cluster", "id")
    blocks = table(in_order.mapInArrow(to_blocks, "block bigint, packed binary"), "blocks")
    asked = _dealt(blocks.mapInArrow(lambda it: ask(it, buckets), BLOBS_DDL), buckets)
    kept = ["told", "lengths", "labels"]
    told = asked.mapInArrow(answer, "block bigint, told binary, lengths binary, labels binary").groupBy("block").agg(*[F.collect_list(c).alias(c) for c in kept])
    listed = table(blocks.join(told, "block").select("packed", *kept).mapInArrow(short_lists, LISTED), "lists")
    total = listed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    own = listed.join(large_keys(listed, "label", "tokens", total), "label", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.hash("packed"), "parts"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "packed"
    )
    return dealt.repartition(buckets, "label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(meet_labels, "a bigint, b bigint")


def node_of(key: str, text: str) -> Column:
    """What tells rows of different keys or texts apart."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id", nodes_only: bool = False) -> DataFrame:
    """key, n_shingles, component_id for each row of docs, by links of similarity 0.75 or more between sets of five words.

    component_id is the smallest key that links reach. Nulls: a null text, or one without words, has an empty
    set and is linked with nothing (its component is its own key); a row with a null key has its n_shingles,
    no links and a null component. Repeated rows give equal results; rows of one key with different texts are
    joined as different documents. Other columns are not read. An empty table gives an empty result. Texts
    are taken whole, and there is no limit on partners, candidates or lists.

    With nodes_only: doc_id, node, first for each distinct key and text with links or words, by node_of(); first
    is the node of its component with the smallest key.
    """
    ready(docs.sparkSession)
    slim = docs.select(node_of(key, text).alias("node"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets = max(12, -(-input_bytes(slim) // BUCKET_BYTES))
    nodes = table(figures(slim, buckets), "figures")
    real = nodes.filter("set_id is not null and doc_id is not null")
    sets = real.groupBy("set_id").agg(F.min(F.struct("doc_id", "node")).alias("rep"), F.max("n").alias("n"), F.max("sampled").alias("sampled"), F.max("shared").alias("shared"), F.count("*").alias("_rows"))
    least = F.col("rep" if nodes_only else "rep.doc_id").alias("least")
    sets = table(sets.select("set_id", F.xxhash64("set_id").alias("id"), least, F.col("rep.node").alias("node"), "n", "sampled", "shared", "_rows"), "sets")
    lonely = F.col("sampled") - F.col("shared")
    able = sets.filter(lonely <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100)).select("id", "node", (lonely / F.greatest("sampled", F.lit(1))).alias("lonely"))
    # rows of equal key and text are one node; any of them will do
    classes = table(slim.select("node", "text").join(able, "node").dropDuplicates(["id"]).select("id", "lonely", "text").mapInArrow(make_sets, CLASSES), "classes")
    told = classes.agg(F.count("*").alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    parts = max(12, -(-told["n"] // BUCKET_TOKENS))
    clusters = clustered(classes, told["m"], told["n"], parts)
    by_set = _components(sets, clusters, across(classes, clusters, parts), told["m"])
    if nodes_only:
        found = join_hot(real.drop("n"), by_set, "set_id", nodes.count(), "node")
        return found.select("doc_id", "node", F.col("component_id.node").alias("first"))
    done = join_hot(nodes, by_set, "set_id", nodes.count(), "node").withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return done.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _components(sets: DataFrame, clusters: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """set_id, component_id, _rows of all sets: the smallest document that links and clusters reach."""
    ends = links.join(clusters.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a").join(clusters.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b")
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    heads = clusters.join(sets.select("id", "least"), "id").groupBy("cluster").agg(F.min("least").alias("m"), F.count("*").alias("_rows"))
    roots = table(heads.join(joined.withColumnRenamed("node", "cluster"), "cluster", "left").withColumn("root", F.coalesce("root", "cluster")), "roots")
    of_root = roots.groupBy("root").agg(F.min("m").alias("component_id"), F.count("*").alias("_rows")).filter("_rows > 1")
    of_cluster = join_hot(roots, of_root, "root", total, "cluster").select("cluster", F.coalesce("component_id", "m").alias("component_id"), "_rows").filter("_rows > 1 or component_id <> m")
    of_class = join_hot(clusters, of_cluster, "cluster", total, "id").select("id", "component_id")
    return sets.join(of_class, "id", "left").select("set_id", F.coalesce("component_id", "least").alias("component_id"), "_rows")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets link, by intersecting them whole, for tests."""
    return len(a) > 0 and len(b) > 0 and len(np.intersect1d(a, b)) >= pair_overlap(len(a), len(b))


def brute(docs: pd.DataFrame) -> dict[int, tuple[int, int]]:
    """The same over all pairs, for tests: doc_id to size and component."""
    sets = {}
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        ws = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))} if ws else set()
    root = {d: d for d in sets}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    has: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        share: dict[int, int] = {}
        for x in s:
            for o in has.setdefault(x, []):
                share[o] = share.get(o, 0) + 1
            has[x].append(d)
        for o, i in share.items():
            if 100 * i >= PERCENT * (len(s) + len(sets[o]) - i):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


# The same over all pairs that share a shingle, for DuckDB.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""
