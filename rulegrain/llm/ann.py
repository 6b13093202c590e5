"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors get one more component that makes all their lengths equal, so the largest inner product is the
smallest distance. Each of a few tables hashes a vector by k projections on normal random directions, cut
into slots of equal width. A query visits, in each table, its own bucket and then those a few slots away, in
the order of their estimated chance of holding a neighbour: by the summed squares of the query's own distances
to the slots' borders. Candidates of all tables are merged and ranked by their exact inner product.

The number of tables, k, the slots' width and the number of probes are fitted: a bounded sample of queries is
answered exactly, and the cheapest setting that reaches the wanted recall on it is taken. All rows are indexed,
and nothing caps buckets: large ones are cut into blocks that are dealt out, and queries go to each block.
Queries that find fewer than they should are answered exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, table

#: Numbers of tables, projections, slot widths (of the vectors' common length) and probes a table that are tried.
TABLES, PROJECTIONS, WIDTHS = (2, 4), (14, 12, 10, 8, 6, 4, 2), (2.0, 2.5)
PROBES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512)
RECALL = 0.93
#: Queries and rows of the sample that these are fitted on.
FIT_QUERIES, FIT_ROWS = 96, 20_000
#: What a probe costs, in candidates.
PROBE_COST = 8
#: Rows of a bucket that stay together; buckets that are told to all tasks, at most: fewer have more than that part of all rows, and smaller ones stay whole.
BLOCK_ROWS, KNOWN_BUCKETS = 4096, 1_000_000
#: Bytes of index for which there is a partition; queries that are ranked at once; rows of small buckets that are ranked at once.
PART_BYTES, QUERY_BATCH, TOGETHER = 16 << 20, 256, 2048
SEED = 11


@dataclass(frozen=True)
class Index:
    """Directions (tables x k x dim + 1), offsets and width of slots, multipliers of slots in keys, and common length."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    multipliers: np.ndarray
    length: float

    def places(self, x: np.ndarray) -> np.ndarray:
        """rows x tables x k: where vectors with their last component fall, in slots."""
        return np.einsum("nd,tkd->ntk", x, self.directions) / self.width + self.offsets

    def keys(self, slots: np.ndarray) -> np.ndarray:
        """rows x tables: one number for the slots of each table."""
        with np.errstate(over="ignore"):
            return (slots.astype(np.int64) * self.multipliers).sum(axis=2) + np.arange(len(self.directions)) * 0x5851F42D4C957F2D

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.length**2 - (v * v).sum(axis=1)))
        return self.keys(np.floor(self.places(np.column_stack([v, rest]))))

    def of_queries(self, q: np.ndarray, probes: int) -> np.ndarray:
        """rows x tables x probes at most: keys to visit, the likeliest of each table first."""
        scaled = unit(q)[0] * self.length
        places = self.places(np.column_stack([scaled, np.zeros(len(q))]))
        slots = np.floor(places)
        n, t, k = places.shape
        moves = likeliest((places - slots).reshape(n * t, k), probes)
        moves = moves.reshape(n, t, moves.shape[1], k)
        with np.errstate(over="ignore"):
            return self.keys(slots)[:, :, None] + (moves * self.multipliers[None, :, None, :]).sum(axis=3)


def likeliest(inside: np.ndarray, probes: int) -> np.ndarray:
    """rows x probes x k: steps of -1, 0 and 1 slots, by ascending sums of squared distances to the borders that they cross.

    inside tells how far into its slots each row lies. Sums are extended by one projection at a time, and the
    smallest are kept: what follows one that isn't among them isn't among the smallest in the end.
    """
    rows, k = inside.shape
    cost, steps = np.zeros((rows, 1)), np.zeros((rows, 1, k), np.int64)
    for j in range(k):
        more = np.stack([np.zeros(rows), inside[:, j] ** 2, (1 - inside[:, j]) ** 2], axis=1)
        every = (cost[:, :, None] + more[:, None, :]).reshape(rows, -1)
        kept = np.argsort(every, axis=1, kind="stable")[:, :probes]
        cost, steps = np.take_along_axis(every, kept, axis=1), np.take_along_axis(steps, kept[:, :, None] // 3, axis=1)
        steps[:, :, j] = np.array([0, -1, 1])[kept % 3]
    return steps


def make_index(dim: int, length: float, tables: int, k: int, width: float) -> Index:
    """Settings with fewer tables or projections have the first ones of larger settings. One table without projections is one bucket: the exact search."""
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(max(TABLES), max(PROJECTIONS), dim + 1))[:tables, :k]
    offsets = rng.uniform(size=(max(TABLES), max(PROJECTIONS)))[:tables, :k]
    multipliers = (rng.integers(1, 2**62, size=(max(TABLES), max(PROJECTIONS)), dtype=np.int64) * 2 + 1)[:tables, :k]
    return Index(directions, offsets, width * length, multipliers, length)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and the lengths that they had; however small these are, their squares don't vanish."""
    most = np.abs(x).max(axis=1, initial=0, keepdims=True)
    most[most == 0] = 1
    x = x / most
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    length[length == 0] = 1
    return x / length, (length * most)[:, 0]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows in double precision, each summed alike wherever it is computed."""
    return np.add.reduce(q * x, axis=-1)


def first_of(i: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of found rows (query, id, score) each query's top by score (ties to the smaller id), each id once, by its largest score."""
    order = np.lexsort((-score, ids, i))
    i, ids, score = i[order], ids[order], score[order]
    again = np.zeros(len(i), bool)
    again[1:] = (i[1:] == i[:-1]) & (ids[1:] == ids[:-1])
    i, ids, score = i[~again], ids[~again], score[~again]
    order = np.lexsort((ids, -score, i))
    i, ids, score = i[order], ids[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < top
    return i[keep], ids[keep], score[keep]


class Ranking:
    """The top found rows of some queries, as blocks of rows come."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, top: int):
        self.ids, self.q, self.top = ids, q, top
        directions, self.lengths = unit(q)
        self.small = directions.astype(np.float32)
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)  # each query's worst row, once it has top of them

    def see(self, ids: np.ndarray, x: np.ndarray, asks: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """Rank rows for the queries that ask (and, of these, only the allowed pairs). Products of 32 bits, with a margin, tell which to rank.

        These are of queries of length 1 and of rows in parts of the longest one's length, so that they fit whatever the lengths are.
        """
        directions, lengths = unit(x)
        longest = lengths.max(initial=np.finfo(np.float64).tiny)
        margin = np.full(len(asks), 1e-6 * (len(x.T) + 8))
        near = self.small[asks] @ (directions * (lengths / longest)[:, None]).astype(np.float32).T
        if allowed is not None:
            near[~allowed] = -np.inf
        least, new = self.least[asks] / self.lengths[asks] / longest, np.isinf(self.least[asks])
        # the best rows here, of which each id may have some, hold as many ids as are wanted, and the query's own
        enough = (self.top + 1) * int(np.unique(ids, return_counts=True)[1].max(initial=1))
        if new.any() and enough < len(ids):
            least[new] = np.partition(near[new], len(ids) - enough, axis=1)[:, len(ids) - enough]
            least[new] -= margin[new]  # by products of 32 bits
        fine = (near >= (least - margin)[:, None]) & (near > -np.inf)
        i, j = np.nonzero(fine)
        i = asks[i]
        other = self.ids[i] != ids[j]
        i, j = i[other], j[other]
        if not len(i):
            return
        score = np.concatenate([exact(self.q[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)])
        now = i, ids[j], score
        self.found = first_of(*(np.concatenate(z) for z in zip(self.found, now, strict=True)), self.top)
        i, _, score = self.found
        last = np.flatnonzero(np.append(i[1:] != i[:-1], True))
        full = np.bincount(i, minlength=len(self.ids))[i[last]] == self.top
        self.least[i[last[full]]] = score[last[full]]


def vectors(column: pa.Array) -> np.ndarray:
    """An array column of one length as rows of doubles."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


FOUND = "query_id bigint, vec_id bigint, score double"


def _found(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v of the rows that take part: v has no null or non-finite component, isn't zero, and has the most common length."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    some = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    dim = some.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return some.filter(F.size("v") == (dim["d"] if dim else 0))


def length_of(v: Column) -> Column:
    """The length of a vector column without nulls; squares are of parts of the largest component, so they fit."""
    most = F.array_max(F.transform(v, F.abs))
    return most * F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / most) * (x / most)))


def brute_force(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, top: int) -> DataFrame:
    """Exact neighbours of a bounded number of queries: each task gives its best, and those are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(query_ids, queries, top)
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                ranking.see(part.column(0).to_numpy(), vectors(part.column(1)), np.arange(len(query_ids)))
        i, v, s = ranking.found
        yield _found(query_ids[i], v, s)

    return ranked(rows.mapInArrow(run, FOUND), top)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's top of what was found, once each."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


@dataclass(frozen=True)
class Fitted:
    """A setting, its probes a table, and its recall and share of rows visited on the sample."""

    index: Index
    probes: int
    recall: float
    share: float


def fitted(rows: DataFrame, queries: DataFrame, n: int, dim: int, length: float, top: int, recall: float = RECALL) -> Fitted | None:
    """The cheapest setting that reaches the recall on a sample of queries, if one does."""
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(FIT_QUERIES).toArrow()
    qid, q = asked.column("id").to_numpy(), np.array(asked.column("v").to_pylist(), np.float64).reshape(-1, dim)
    nearest = brute_force(rows, qid, q, top).select("query_id", F.col("vec_id").alias("id"))
    truth = rows.join(F.broadcast(nearest), "id").groupBy("query_id", "id").agg(F.min("v").alias("v")).toArrow()  # FIT_QUERIES * top rows at most
    owner = np.argsort(qid)[np.searchsorted(np.sort(qid), truth.column("query_id").to_numpy())] if len(qid) else np.zeros(0, np.int64)
    x = np.array(truth.column("v").to_pylist(), np.float64).reshape(-1, dim)
    seen = rows.orderBy(F.xxhash64("id", F.lit(1)), "id", "v").limit(FIT_ROWS).select("v").toArrow()
    sample = np.array(seen.column("v").to_pylist(), np.float64).reshape(-1, dim)
    choice: tuple[float, Fitted] | None = None
    for tables in TABLES:
        for k in PROJECTIONS:
            for width in WIDTHS:
                index = make_index(dim, length, tables, k, width)
                visits = index.of_queries(q, max(PROBES))
                ranks = _ranks(visits, owner, index.of_rows(x))  # by how many probes each true neighbour is reached
                reached = next((p for p in PROBES if len(x) == 0 or (ranks < p).mean() >= recall), None)
                if reached is None:
                    continue
                held = index.of_rows(sample)
                shares = [[np.isin(held[:, t], visits[i, t, :reached]) for t in range(tables)] for i in range(0, len(q), 4)]
                cost = np.mean([np.sum(s) for s in shares]) / max(1, len(sample)) * n + PROBE_COST * reached * tables
                if choice is None or cost < choice[0]:
                    share = float(np.mean([np.any(s, axis=0).mean() for s in shares]))
                    choice = cost, Fitted(index, reached, float((ranks < reached).mean()) if len(x) else 1.0, share)
    return choice[1] if choice else None


def _ranks(visits: np.ndarray, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For rows with an owning query the place of the first probe, in any table, that visits them; the number of probes if none does."""
    hit = visits[owner] == keys[:, :, None]
    return np.where(hit.any(axis=2), hit.argmax(axis=2), visits.shape[2]).min(axis=1, initial=visits.shape[2])


def search(rows: DataFrame, queries: DataFrame, index: Index, probes: int, n: int, dim: int, top: int) -> DataFrame:
    """Each query's top of the candidates that its probes reach."""
    tables = len(index.directions)
    parts = max(12, -(-n * tables * (8 * dim + 24) // PART_BYTES))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = index.of_rows(vectors(b.column(1))) if b.num_rows else np.zeros((0, tables), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64())], names=["key"])

    least = max(BLOCK_ROWS, n * tables // KNOWN_BUCKETS)
    sizes = rows.mapInArrow(hashed, "key bigint").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    large = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS)).select("key", "blocks").toArrow()
    order = np.argsort(large.column("key").to_numpy())
    known = rows.sparkSession.sparkContext.broadcast((large.column("key").to_numpy()[order], large.column("blocks").to_numpy()[order]))

    def part_of(key: np.ndarray, block: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(29))) % np.uint64(parts)).astype(np.int64)

    def blocks_of(key: np.ndarray) -> np.ndarray:
        keys, blocks = known.value
        if not len(keys):
            return np.ones(key.shape, np.int64)
        at = np.searchsorted(keys, key).clip(max=len(keys) - 1)
        return np.where(keys[at] == key, blocks[at], 1)

    schema = pa.schema([("part", pa.int64()), ("asks", pa.bool_()), ("id", pa.int64()), ("v", pa.binary()), ("keys", pa.binary())])
    ddl = "part bigint, asks boolean, id bigint, v binary, keys binary"

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), vectors(b.column(1))
            keys = index.of_rows(x)
            mixed = (ids.astype(np.uint64) * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)
            part = part_of(keys, mixed[:, None] % blocks_of(keys).astype(np.uint64))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[:, t]), pa.array(np.zeros(len(ids), bool)), pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([k.tobytes() for k in keys[:, t]], pa.binary())],
                    schema=schema,
                )

    def query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BATCH):
                some = b.slice(at, QUERY_BATCH)
                ids, q = some.column(0).to_numpy(), vectors(some.column(1))
                visits = index.of_queries(q, probes).reshape(len(q), -1)
                out = []
                for i in range(len(ids)):
                    keys = np.unique(visits[i])
                    m = blocks_of(keys)
                    spread = np.repeat(keys, m)
                    block = np.arange(len(spread)) - np.repeat(np.cumsum(m) - m, m)
                    part = part_of(spread, block)
                    order = np.argsort(part, kind="stable")
                    part, spread = part[order], spread[order]
                    cut = np.flatnonzero(np.diff(part, prepend=-1))
                    for a, z in zip(cut, np.append(cut[1:], len(part)), strict=True):
                        out.append((int(part[a]), True, int(ids[i]), q[i].tobytes(), spread[a:z].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part in order: its index first, then queries as they come."""
        part, held, waiting, built = None, [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal built
            if waiting and (held or built):
                if built is None:
                    ids, x, key = (np.array([r[0] for r in held]), np.frombuffer(b"".join(r[1] for r in held), np.float64).reshape(-1, dim), np.frombuffer(b"".join(r[2] for r in held), np.int64))
                    order = np.argsort(key, kind="stable")
                    built = ids[order], x[order], *np.unique(key[order], return_index=True), len(key)
                    held.clear()
                yield from _ranked_part(built, waiting, dim, top)
            waiting.clear()

        for b in batches:
            for p, asks, i, v, k in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if p != part:
                    yield from flush()
                    part, built = p, None
                    held.clear()
                (waiting if asks else held).append((i, v, k))
                if len(waiting) >= QUERY_BATCH:
                    yield from flush()
        yield from flush()

    both = rows.mapInArrow(index_rows, ddl).unionByName(queries.mapInArrow(query_rows, ddl))
    met = both.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "asks").mapInArrow(meet, FOUND)
    return ranked(met, top)


def _ranked_part(built: tuple, waiting: list[tuple[int, bytes, bytes]], dim: int, top: int) -> Iterator[pa.RecordBatch]:
    ids, x, keys, begin, n = built
    qid = np.array([r[0] for r in waiting])
    q = np.frombuffer(b"".join(r[1] for r in waiting), np.float64).reshape(-1, dim)
    visits = np.zeros((len(waiting), len(keys)), bool)
    for i, r in enumerate(waiting):
        k = np.frombuffer(r[2], np.int64)
        at = np.searchsorted(keys, k).clip(max=len(keys) - 1)
        visits[i, at[keys[at] == k]] = True
    size = np.diff(np.append(begin, n))
    ranking, asked = Ranking(qid, q, top), visits.any(axis=0)
    todo: list[int] = []
    # large buckets are ranked for the queries that visit them, small ones some at once
    for u in [*np.flatnonzero(asked).tolist(), -1]:
        if todo and (u < 0 or size[todo].sum() + size[u] > TOGETHER):
            rows = np.concatenate([np.arange(begin[t], begin[t] + size[t]) for t in todo])
            asks = np.flatnonzero(visits[:, todo].any(axis=1))
            bucket = np.repeat(np.arange(len(todo)), size[todo])
            for a in range(0, len(rows), TOGETHER):
                some = rows[a : a + TOGETHER]
                ranking.see(ids[some], x[some], asks, visits[np.ix_(asks, todo)][:, bucket[a : a + TOGETHER]] if len(todo) > 1 else None)
            todo = []
        todo.append(u)
    i, v, s = ranking.found
    yield _found(qid[i], v, s)


def nearest(rows: DataFrame, top: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose key is divisible by every, the top others by inner product.

    Nulls: rows with a null key or vector, a null or non-finite component, a zero vector, or a length other
    than the most common one take no part. Ties in score go to the smaller key. Rows of one key count once: as
    candidates by their largest score, as queries by their smallest vector. Other columns are not read, so
    they may have any names. An empty table gives an empty result. Vectors may be of any size: they are ranked by
    products that are scaled to fit; a score beyond the doubles' range is told as infinite, or zero.
    """
    ready(rows.sparkSession)
    used = usable(rows, key, vector)
    told = used.agg(F.count("*").alias("n"), F.max(length_of(F.col("v"))).alias("m"), F.max(F.size("v")).alias("d"), F.count_distinct("id").alias("ids")).first()
    if not told["n"]:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # all work is done on vectors times a power of 2 that makes the longest about 1: exact, and products fit whatever the vectors' size
    power = int(np.clip(np.frexp(told["m"])[1], -1000, 1000)) if np.isfinite(told["m"]) else 1000
    used = table(used.withColumn("v", F.transform("v", lambda x: x * F.lit(2.0**-power))), "vectors")  # they are read some ten times
    n, dim, length = told["n"], told["d"], min(float(told["m"]), 2.0**1023) * 2.0**-power * (1 + 1e-12)
    queries = used.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    setting = fitted(used, queries, n, dim, length, top, recall)
    one = make_index(dim, length, 1, 0, 1.0)
    if setting is None:  # no setting serves these rows: one bucket, which is the exact search
        return with_scores(search(used, queries, one, 1, n, dim, top), power)
    found = table(search(used, queries, setting.index, setting.probes, n, dim, top), "neighbours")
    # buckets may hold too few; such queries are answered by the exact search
    full = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("c")).filter(F.col("c") >= min(top, told["ids"] - 1)).select("id")
    short = queries.join(full, "id", "left_anti")
    if not short.isEmpty():
        rest = search(used, short, one, 1, n, dim, top)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return with_scores(found, power)


def with_scores(found: DataFrame, power: int) -> DataFrame:
    """The result with scores of the vectors as they were, from scores of vectors times 2 to the minus power."""
    back = F.lit(2.0**power)
    return found.select("query_id", "rank", "vec_id", (F.col("score") * back * back).alias("score"))


def measured_recall(found: pd.DataFrame, truth: pd.DataFrame) -> float:
    """Share of the true neighbours (query_id, vec_id) that were found, for the queries of truth."""
    return len(truth.merge(found, on=["query_id", "vec_id"])) / max(1, len(truth))
