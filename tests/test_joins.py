"""Ranks in two passes, similarity by classes and word diffs of bounded memory, against plain versions."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulegrain.functions import diffs
from rulegrain.operators import compliance, seeding
from rulegrain.operators import similarity as SIM
from rulegrain.operators.ranks import with_ranks


def test_ranks(spark):
    """One hot group over many tasks, small ones, nulls, ties."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "repo_id string, v int, id int").repartition(5)
    got = with_ranks(df, ["repo_id"], [F.col("v"), F.col("id")]).collect()
    for repo in ("hot", "a", "b", None):
        want = sorted((v, i) for r, v, i in rows if r == repo)
        mine = sorted((r["rank"], r["v"], r["id"], r["count"]) for r in got if r["repo_id"] == repo)
        assert mine == [(k, v, i, len(want)) for k, (v, i) in enumerate(want)]
    tied = with_ranks(df, ["repo_id"], [F.lit(0)]).collect()
    assert sorted(r["rank"] for r in tied if r["repo_id"] == "hot") == list(range(sum(r[0] == "hot" for r in rows)))
    assert with_ranks(df.limit(0), ["repo_id"], [F.col("v")]).count() == 0
    plan = with_ranks(df, ["repo_id"], [F.col("v")])._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan


def test_samples_by_ranks(spark):
    rows = [(f"r{i % 3}", f"k{i:03d}é", f"C{i % 7}") for i in range(90)]
    pairs = spark.createDataFrame(rows, "repo_id string, rule_id string, chunk_id string").repartition(4)
    got = {tuple(r) for r in compliance.calibration_sample(pairs, 0.1).collect()}
    assert got == {r for k in range(3) for r in sorted(x for x in rows if x[0] == f"r{k}")[::10]}
    spread = {tuple(r) for r in seeding.spread_sample(pairs, 7, ["rule_id"]).collect()}
    assert spread == {sorted(x for x in rows if x[0] == f"r{k}")[i * 30 // 7] for k in range(3) for i in range(7)}


def plain_diff(a, b):
    """The table of all lengths."""
    n = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i, j] = n[i + 1, j + 1] + 1 if a[i] == b[j] else max(n[i + 1, j], n[i, j + 1])
    steps, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            steps.append((0, a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and n[i + 1, j] >= n[i, j + 1]):
            steps.append((1, a[i]))
            i += 1
        else:
            steps.append((2, b[j]))
            j += 1
    out = []
    for k, (form, word) in enumerate(steps):
        if any(f for f, _ in steps[max(0, k - 2) : k + 3]):
            out.append((word, f"[-{word}-]", f"{{+{word}+}}")[form])
        elif not out or out[-1] != "…":
            out.append("…")
    return " ".join(out)


def test_word_diffs_are_the_tables():
    rng = random.Random(2)
    for _ in range(400):
        a, b = (rng.choices("abcd", k=rng.randint(0, 25)) for _ in "ab")
        if rng.random() < 0.4:
            b = a[:3] + b[: rng.randrange(4)] + a[3:]
        assert diffs.diff_words(a, b) == plain_diff(a, b)


def test_word_diff_of_long_texts_in_bounded_memory():
    rng = random.Random(3)
    a = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    b = [w if rng.random() > 0.01 else "changed" for w in a]
    tracemalloc.start()
    text = diffs.diff_words(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and text.count("{+changed+}") == b.count("changed")


@pytest.mark.parametrize("seed", range(2))
def test_similar_pairs_are_all(spark, seed):
    rng = random.Random(seed)
    bases = [[f"word{rng.randrange(40)}" for _ in range(rng.randint(4, 20))] for _ in range(8)]
    rows = []
    for i in range(90):
        ws = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(len(ws))] = f"word{rng.randrange(40)}"
        rows.append((rng.choice("rs"), f"i{i}", i, rng.choice(["g1", "g2", "g3"]), " ".join(ws)))
    rows += [("r", "e1", 900, "g1", ""), ("r", "e2", 901, "g2", "--"), ("r", "n", 902, "g2", None)]
    sets = SIM.with_shingles(spark.createDataFrame(rows, "repo_id string, id string, ord int, grp string, text string"))
    got = {(r["repo_id"], r["a"], r["b"]): r["j"] for r in SIM.similar_pairs(sets, 0.6).collect()}
    token = {r["id"]: set(r["tokens"] or []) for r in sets.collect()}
    want = {}
    for x in rows:
        for y in rows:
            a, b = token[x[1]], token[y[1]]
            if x[0] == y[0] and x[2] < y[2] and x[3] != y[3] and a and len(a & b) / len(a | b) >= 0.6:
                want[x[0], x[1], y[1]] = len(a & b) / len(a | b)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_equal_rows_are_one_class(spark):
    """Ten thousand copies are compared once with what is like them."""
    text = "keep every module small and name its exports in one place"
    rows = spark.range(10_000).selectExpr("concat('r', id % 1) repo_id", "id", "int(id) ord", "id grp", f"if(id = 7, '{text} always', '{text}') text")
    distinct, told = SIM.classes(SIM.with_shingles(rows))
    assert distinct.count() == 2 and told.count() == 10_000
    assert [round(r["j"], 3) for r in SIM.similar_classes(distinct, 0.6).collect()] == [0.875]
