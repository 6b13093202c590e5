"""Joins, dedup, search and mixing against brute force, with hot groups, nulls, ties and empty tables."""

import random

import numpy as np
import pandas as pd
import pytest

from rulegrain.llm import ann, jaccard_join, mixing, substring_dedup
from rulegrain.llm.components import components


def near_copies(seed, n=120, families=6, words=80, edits=12, vocabulary=60):
    """Families of edited copies, exact copies, short texts and a passage that many share."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(5, words))] for _ in range(families)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(bases))
        for _ in range(rng.randrange(edits)):
            ws[rng.randrange(len(ws))] = f"w{rng.randrange(vocabulary)}"
        if rng.random() < 0.3:
            ws = passage + ws
        rows.append((i * 3 % 1009, " ".join(ws)))
    return [*rows, (2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (2004, "one two three four five"), (2005, " \t\n")]


@pytest.mark.parametrize("seed", range(4))
def test_jaccard_join(spark, seed):
    rows = near_copies(seed, n=150, edits=16)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = jaccard_join.brute(pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df).collect()}
    assert got == want


def test_search_is_exhaustive():
    """The search between clusters alone, without the rounds before it: all links' components, parts or not."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.25, rng.integers(0, 2**63, 60).astype(np.uint64), base)) for _ in range(80)]
    has = np.unique(np.concatenate(sets), return_counts=True)
    several, df = has[0][has[1] > 1], dict(zip(has[0].tolist(), has[1].tolist(), strict=True))
    rows = []
    for i, s in enumerate(sets):
        own = s[np.isin(s, several)]
        own = own[np.lexsort((own, [df[x] for x in own.tolist()]))]
        need = jaccard_join.least_overlap(len(s))
        if len(own) >= need:
            rows.append({"id": i, "cluster": i, "n": len(s), "short": len(own) - need + 1, "tokens": own.tobytes()})

    def roots(links):
        r = list(range(len(sets)))
        for a, b in links:
            x, y = r[a], r[b]
            r = [min(x, y) if v in (x, y) else v for v in r]
        return r

    true = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard_join.alike(sets[i], sets[j])]
    assert len(true) > 50
    for heap in (0, 10**9):
        jaccard_join.HEAP_MEMBERS = heap
        assert roots(jaccard_join.search(rows, [0] * len(rows))) == roots(true)
    side = [i % 2 for i in range(len(rows))]
    halves = [list(jaccard_join.search([r for r, x in zip(rows, side, strict=True) if x == k], [0] * side.count(k))) for k in (0, 1)]
    assert roots([*halves[0], *halves[1], *jaccard_join.search(rows, side)]) == roots(true)


def test_leaders_are_real_links(monkeypatch):
    rng = np.random.default_rng(3)
    bases = [rng.integers(0, 2**63, 80).astype(np.uint64) for _ in range(4)]
    rows = [(i, np.unique(np.where(rng.random(80) < 0.04, rng.integers(0, 2**63, 80).astype(np.uint64), bases[i % 4]))) for i in range(200)]
    for heap in (0, 10**9):
        monkeypatch.setattr(jaccard_join, "HEAP_MEMBERS", heap)
        found = list(jaccard_join.led(rows))
        assert len(found) == 196 and {b for _, b in found} == {0, 1, 2, 3} and all(a % 4 == b for a, b in found)
    # one that two leaders hang on joins them
    x, y = (np.arange(k, k + 100, dtype=np.uint64) for k in (0, 20))
    assert not jaccard_join.alike(x, y) and sorted(jaccard_join.led([(1, x), (2, y), (3, np.arange(10, 110, dtype=np.uint64))])) == [(2, 1), (3, 1)]


def test_hot_keys_are_dealt(spark, monkeypatch):
    from rulegrain.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    big = spark.createDataFrame([(i, 1 if i < 50 else i) for i in range(70)], "id bigint, k bigint")
    small = spark.createDataFrame([(1, "a", 50), (55, "b", 1)], "k bigint, v string, _rows bigint")
    got = {r["id"]: r["v"] for r in common.join_hot(big, small, "k", 70, "id").collect()}
    assert got == {i: "a" if i < 50 else "b" if i == 55 else None for i in range(70)}


def test_join_of_long_and_many(spark, monkeypatch):
    """A hot group of near copies and very long texts, in parts of few tokens."""
    monkeypatch.setattr(jaccard_join, "TOGETHER", 3000)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        ws = list(base)
        for _ in range(rng.randrange(9)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    long = [f"l{i}" for i in range(30_000)]
    rows += [(400, " ".join(long)), (401, " ".join(long[:-3000])), (402, " ".join(long[9000:]))]
    want = jaccard_join.brute(pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_join_edges(spark):
    rows = [(None, "a b c d e f", 1), (5, "a b c d e f", 2), (4, "a b c d e f", 3), (5, "a b c d e f", 2), (6, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df).collect())
    assert got == [(0, 2, None), (4, 2, 4), (5, 2, 4), (5, 2, 4), (6, 1, 6)]
    assert jaccard_join.jaccard_join(df.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (11, 10), (5, 5), (3, 9)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10} | {100 + i: 100 for i in range(21)}


@pytest.mark.parametrize("seed", range(2))
def test_substring_dedup(spark, seed, monkeypatch):
    import hashlib

    monkeypatch.setattr(substring_dedup, "SLICE_CHARS", 200)
    rows = near_copies(seed, words=200)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = substring_dedup.brute(pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substring_dedup.substring_dedup(df, buckets=5).collect()}
    assert got == want and sum(v[1] for v in got.values()) > 500


def test_frequent_minimisers_share_buckets(spark, monkeypatch):
    """Windows that all have one run of words, the smallest of their hashes: few stay in its bucket, and the result is the same."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    hot = min(((a, b, c) for a, b, c in (rng.sample(words, 3) for _ in range(3000))), key=lambda x: int(substring_dedup.rolled(substring_dedup.word_hashes(list(x)), 3)[0]))
    rows = [(i, " ".join(w for _ in range(12) for w in [*rng.sample(words, 5), *hot, *rng.sample(words, 4)])) for i in range(120)]
    rows += [(200 + i, rows[i * 7][1][100:]) for i in range(10)]
    monkeypatch.setattr(substring_dedup, "SAMPLED", 2)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "xxhash64(text) AS text_hash", "text")
    frequent = substring_dedup.frequent_slots(df, 16)
    slot = substring_dedup.slot_of(substring_dedup.rolled(substring_dedup.word_hashes(list(hot)), 3) >> np.uint64(1))
    assert frequent[slot].all() and frequent.sum() < 50
    load = {}
    for flags in (frequent, frequent & False):
        n = np.zeros(16, np.int64)
        for _, text in rows[:120]:
            ws = text.split(" ")
            _, k, low, _ = substring_dedup.super_kmers(substring_dedup.word_hashes(ws), np.array([len(ws)]), flags)
            np.add.at(n, (low % np.uint64(16)).astype(int), k)
        load[bool(flags.any())] = n.max() / np.median(n)
    assert load[True] < 2 < load[False]
    import hashlib

    want = substring_dedup.brute(pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substring_dedup.substring_dedup(df.select("doc_id", "text"), buckets=16).collect()}
    assert got == want


def test_slices_and_edges(spark):
    ws = [f"w{i}" for i in range(500)]
    parts = list(substring_dedup.slices(" ".join(ws), 100))
    windows = [(b + i, tuple(w[i : i + 13])) for b, w in parts for i in range(len(w) - 12)]
    assert windows == [(i, tuple(ws[i : i + 13])) for i in range(488)]
    text = " ".join(ws[:20])
    df = spark.createDataFrame([(None, text, 1), (7, text, 2), (3, text, 3), (7, text, 4), (8, None, 5)], "doc_id bigint, text string, kept int")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [(0, 20, 0), (3, 20, 0), (7, 20, 20), (7, 20, 20), (8, 0, 0)]
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    x[300:600] = x[0] * 1.1 + rng.normal(size=(300, 16)) * 1e-6  # a hot group
    x[600:640] = x[1]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [1.0, None] + [1.0] * 14), (1080, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(df).toPandas()
    truth = []
    for q in range(0, 900, 20):
        s = ann.exact(x[q][None, :], x)
        s[q] = -np.inf
        truth += [(q, r + 1, int(v), s[v]) for r, v in enumerate(np.lexsort((np.arange(900), -s))[:20])]
    truth = pd.DataFrame(truth, columns=["query_id", "rank", "vec_id", "score"])
    assert ann.measured_recall(got, truth) >= 0.9 and (got.groupby("query_id").size() == 20).all() and set(got.query_id) == set(range(0, 900, 20))
    both = got.merge(truth, on=["query_id", "vec_id"], suffixes=("", "_t"))
    assert np.abs(both.score - both.score_t).max() < 1e-12
    tied = got[got.query_id == 620].sort_values("rank")
    assert tied.vec_id.tolist() == [v for v in [1, *range(600, 640)] if v != 620][:20]
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.filter("vec_id < 5")).toPandas()
    assert len(few) == 4 and sorted(few.vec_id) == [1, 2, 3, 4]


@pytest.mark.parametrize("kind, scales", [("double", [1.0, 1e-200, 1e-30, 1e25, 1e150]), ("float", [1.0, 1e-24, 1e19, 1e25])])
def test_vectors_of_any_size(spark, kind, scales):
    """The same neighbours whatever the vectors' size, and the score of the vectors as they are; null ids take no part."""
    x = np.random.default_rng(7).normal(size=(400, 16)).astype(np.float32).astype(np.float64)
    want = None
    for scale in scales:
        near = 2.0 ** np.round(np.log2(scale))
        rows = [(i, (v * near).tolist()) for i, v in enumerate(x)] + [(None, (x[0] * near).tolist())]
        got = ann.nearest(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")).toPandas()
        assert len(got) == 400 and (got.groupby("query_id").size() == 20).all()
        if 1e-150 < near < 1e150:
            assert (got.score.to_numpy() == [ann.exact(x[q] * near, x[v] * near) for q, v in zip(got.query_id, got.vec_id, strict=True)]).all()
        pairs = set(zip(got.query_id, got["rank"], got.vec_id, strict=True))
        want = want or pairs
        assert pairs == want
    truth = [(q, int(v)) for q in range(0, 400, 20) for s in [np.where(np.arange(400) == q, -np.inf, x @ x[q])] for v in np.argsort(-s)[:20]]
    assert ann.measured_recall(got, pd.DataFrame(truth, columns=["query_id", "vec_id"])) >= 0.9


def test_ranking_of_mixed_sizes():
    """The exact ranking alone: rows and queries far apart in size, in one block and over blocks."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8)) * 10.0 ** rng.integers(-60, 60, (300, 1))
    q = rng.normal(size=(6, 8)) * 10.0 ** rng.integers(-60, 60, (6, 1))
    ranking = ann.Ranking(np.arange(1000, 1006), q, 20)
    for at in range(0, 300, 70):
        ranking.see(np.arange(at, min(300, at + 70)), x[at : at + 70], np.arange(6))
    i, v, s = ranking.found
    for k in range(6):
        true = ann.exact(q[k][None, :], x)
        assert v[i == k].tolist() == np.lexsort((np.arange(300), -true))[:20].tolist() and s[i == k].tolist() == np.sort(true)[::-1][:20].tolist()


def test_probes_come_in_order():
    from itertools import product

    inside = np.random.default_rng(1).random((5, 6))
    for row, steps in zip(inside, ann.likeliest(inside, 200), strict=True):
        cost = lambda s: sum({0: 0, -1: r * r, 1: (1 - r) ** 2}[int(x)] for r, x in zip(row, s, strict=True))  # noqa: B023, E731
        every = sorted(cost(s) for s in product((-1, 0, 1), repeat=6))
        assert np.allclose([cost(s) for s in steps], every[:200]) and not steps[0].any() and len({tuple(s) for s in steps.tolist()}) == 200


def test_few_rows_are_visited_in_clusters(spark):
    """Clustered vectors: under a tenth of the rows is visited, at the wanted recall."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(100, 16))
    x = centers[rng.integers(0, 100, 4000)] + rng.normal(size=(4000, 16)) * 0.05
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    used = ann.usable(df, "vec_id", "embedding").withColumnRenamed("v", "v")
    queries = used.filter("id % 20 = 0")
    setting = ann.fitted(used, queries, 4000, 16, 1.0 + 1e-9, 20)
    assert setting.share < 0.1 and setting.recall >= ann.RECALL
    got = ann.nearest(df).toPandas()
    truth = [(q, int(v)) for q in range(0, 4000, 20) for s in [np.where(np.arange(4000) == q, -np.inf, x @ x[q])] for v in np.lexsort((np.arange(4000), -s))[:20]]
    assert ann.measured_recall(got, pd.DataFrame(truth, columns=["query_id", "vec_id"])) >= 0.9


def test_rows_of_one_id(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 8))
    rows = [(i // 2, v.tolist(), 1, "r") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int, score string")
    runs = [sorted(map(tuple, ann.nearest(d).collect())) for d in (df, df.repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == 60 and len({(r[0], r[2]) for r in runs[0]}) == 60 and all(r[0] != r[2] for r in runs[0])


def plain_mix(rows, weights=(1, 2, 3)):
    """DuckDB's version of the mix, for doc_id to (size, source_size, target, taken)."""
    import duckdb

    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    con.register("frame", frame)
    con.sql("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM frame")
    return con.sql(mixing.SQL).df()


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", "c", "d", None]
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choices(sources, [20, 5, 1, 3, 2])[0]) for i in range(300)] + [(300, None, "a"), (301, "", "b"), (302, "x y", "tiny")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)).drop("source_key").toPandas().sort_values("doc_id").reset_index(drop=True)
    want = plain_mix(rows).sort_values("doc_id").reset_index(drop=True)
    for c in ("doc_id", "size", "source_size", "target", "taken"):
        assert (got[c] == want[c]).all(), c
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all() and got.taken.sum() <= got["size"].sum()
    by = pd.DataFrame(rows, columns=["doc_id", "t", "s"]).merge(got, on="doc_id").fillna({"s": "-"}).groupby("s").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 45).all() and abs(by.target.sum() - got["size"].sum()) < 1e-6
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_mixing_in_small_ranges(spark, monkeypatch):
    """A hot source, a hot null key, repeated rows and clashing names, in ranges of few rows."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    rng = random.Random(4)
    rows = [(i if i % 3 else None, " ".join(["w"] * rng.randint(0, 9)), rng.choices(["a", "b", None], [8, 1, 1])[0], "x", 5) for i in range(200)]
    rows += [(1, "w w", "a", "x", 5)] * 20 + [(1, "v w", "a", "x", 5)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, taken string, target int")
    runs = [sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in mixing.mix(d).collect()), key=str) for d in (df, df.repartition(7))]
    want = plain_mix([r[:3] for r in rows])
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    assert sum(r[3] for r in runs[0]) <= sum(r[1] for r in runs[0]) and all(r[3] in (0, r[1], 2 * r[1], 3 * r[1]) for r in runs[0])
    assert abs(sum(r[3] for r in runs[0]) - want["size"].sum()) <= 9 and want["size"].sum() == sum(r[1] for r in runs[0])


def test_mixing_without_words(spark):
    got = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")).collect()
    assert [r["taken"] for r in got] == [0, 0]
