"""Joins of pairs by classes and blocks, against plain versions, and what their plans move."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rulegrain.functions import diffs
from rulegrain.functions.diffs import diff_words
from rulegrain.operators import contradiction as D
from rulegrain.operators import similarity as SIM
from rulegrain.operators.structure import mean_overlap
from tests.test_joins import plain_diff


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rules_of(spark, texts):
    rows = [(f"r{i % 2}", f"i{i}", i, f"g{i % 3}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "repo_id string, id string, ord int, grp string, text string"), rows


def test_opposed_rules_by_classes(spark):
    """rules that say the same are joined once; two classes of over BLOCK rules give all their pairs."""
    rng = random.Random(5)
    texts = [f"{rng.choice(['Always', 'Never', 'Do not'])} use {rng.choice(['red', 'big'])} {rng.choice(['rings', 'bolts'])} in {rng.choice(['small', 'old'])} builds. {rng.choice(['', 'Never use big rings in old builds.'])}" for _ in range(1400)]
    df, _ = rules_of(spark, texts)
    said = D.directives(df.select("repo_id", F.col("id").alias("rule_id"), "ord", F.col("grp").alias("surface_id"), "text"))
    words = {}
    for r in said.collect():
        words.setdefault((r["repo_id"], r["ord"], r["rule_id"]), []).extend((r["polarity"], p) for p in r["core"])
    by_marks = {k: Counter(v) for k, v in words.items()}
    shapes = {k: frozenset(v.items()) for k, v in by_marks.items()}
    known = {}

    def shared(x, y):
        if (shapes[x], shapes[y]) not in known:
            known[shapes[x], shapes[y]] = sum(n * m for (p, g), n in by_marks[x].items() for (q, h), m in by_marks[y].items() if g == h and p != q)
        return known[shapes[x], shapes[y]]

    want = Counter((x[0], x[2], y[2], n) for x in words for y in words if x[0] == y[0] and x[1] < y[1] and (n := shared(x, y)) >= D.LEAST_SHARED)
    assert Counter(map(tuple, D.opposed(said).collect())) == want and len(want) > 10_000


@pytest.mark.parametrize("least", [0.6, 0.9])
def test_linkable_sets(spark, least):
    """sets of lonely shingles are left out before sets are joined, those with a partner never; blocks of copies give all pairs."""
    rng = random.Random(6)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 12, 60, 300]))] for _ in range(120)]
    texts = [" ".join(b) for b in base] + ["one and the same text of many rules"] * 600
    for b in base[:30]:
        w = list(b)
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    df, rows = rules_of(spark, texts)
    sets = SIM.with_shingles(df.withColumn("repo_id", F.lit("r")))
    token = {r["id"]: frozenset(r["tokens"]) for r in sets.collect()}
    distinct, _ = SIM.classes(sets)
    left = SIM.linkable(distinct, least)
    assert left.count() < distinct.count() - 60
    got = Counter((r["a"], r["b"]) for r in SIM.similar_pairs(sets, least).collect())
    grp, first = {x[1]: x[3] for x in rows}, {x[1]: x[2] for x in rows}
    want = Counter((a, b) for a, s in token.items() for b, t in token.items() if first[a] < first[b] and grp[a] != grp[b] and (s is t or s == t or len(s & t) >= least * len(s | t)))
    assert got == want


def test_shingles_move_no_rows(spark):
    """no exchange, and a filter on what is made of words doesn't make them again."""
    df, _ = rules_of(spark, ["a b c d e f g", "a b", ""])
    sets = SIM.with_shingles(df)
    assert "Exchange" not in plan_of(sets)
    assert plan_of(sets.filter("n > 1").select("n", "words")).count("regexp_extract_all(") == 1
    assert [r["n"] for r in sets.orderBy("ord").collect()] == [3, 1, 0]


def test_mean_overlap_of_passages(spark):
    """shingles of one passage meet as one group; the mean is that of all pairs."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 25))) + (f" {passage}" if i % 3 else "") for i in range(60)] + ["same words here as there now"] * 5 + ["", "x"]
    sets = SIM.with_shingles(spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "repo_id string, id int, text string"))
    held = [frozenset(r["tokens"]) for r in sets.collect()]
    pairs = [(s, t) for i, s in enumerate(held) for t in held[:i]]
    want = sum(len(s & t) / len(s | t) if s | t else 0.0 for s, t in pairs) / len(pairs)
    got = mean_overlap(sets.select("repo_id", "id", "n", "words")).first()
    assert got["files"] == len(texts) and abs(got["mean"] - want) < 1e-9


@pytest.mark.parametrize("tile", [7, 200, 200_000])
def test_mean_overlap_by_tiles(spark, monkeypatch, tile):
    """no pair of sets is a row; tiles of any size give the mean of all pairs, also of copies and of many sets with one line."""
    from rulegrain.operators import structure

    monkeypatch.setattr(structure, "TILE", tile)
    rng = random.Random(9)
    lines = [" ".join(f"l{k}w{i}" for i in range(rng.randrange(5, 12))) for k in range(4)]
    texts = [" ".join([f"own{i}word{rng.randrange(3)} "] * rng.randrange(9) + rng.sample(lines, rng.choice([0, 1, 1, 2]))) for i in range(150)]
    texts += rng.choices(texts, k=20) + [f"{lines[0]} end{i}" for i in range(60)] + ["", "x", "x"]
    rows = [(f"r{i % 2}" if i % 7 else "s", i, t) for i, t in enumerate(texts)]
    sets = SIM.with_shingles(spark.createDataFrame(rows, "repo_id string, id int, text string"))
    held = {}
    for r in sets.collect():
        held.setdefault(r["repo_id"], []).append(frozenset(r["tokens"]))
    mean = mean_overlap(sets.select("repo_id", "id", "n", "words"))
    assert "(ca#" not in plan_of(mean) and "FlatMapGroupsInArrow" in plan_of(mean)
    got = {r["repo_id"]: r for r in mean.collect()}
    for repo, own in held.items():
        pairs = [(s, t) for i, s in enumerate(own) for t in own[:i]]
        want = sum(len(s & t) / len(s | t) if s | t else 0.0 for s, t in pairs) / len(pairs)
        assert got[repo]["files"] == len(own) and abs(got[repo]["mean"] - want) < 1e-9


def test_surfaces_are_parsed_once(spark):
    """neither surfaces, nor their rules' ranks, parse again."""
    from rulegrain.sources import repos

    rows = [("r", f"s{i}", f"p{i}.mdc", "cursor-rule", f"---\nglobs: a{i}/**\n---\n- Keep {i}.\n- Drop {i}.") for i in range(20)]
    known, rules = repos.parse(spark.createDataFrame(rows, "repo_id string, surface_id string, path string, kind string, raw string"))
    assert "EvalPython" not in plan_of(known) + plan_of(rules)
    assert known.count() == 20 and sorted(r["ord"] for r in rules.collect()) == list(range(1, 41))


def test_word_diffs_by_texts(spark, tmp_path):
    """copies of two texts ask for one diff, in the order of their rows."""
    from rulegrain.plans import queries as Q

    one = "a b c d e f g h i j k l m n o p"
    texts = [one, one.replace("p", "q"), one, one.replace("p", "q")]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    told = Q.word_diffs(spark, str(tmp_path))
    assert "EvalPython" not in plan_of(told)
    got = {(r["a"], r["b"]): r["diff"] for r in told.collect()}
    tail = lambda a, b: f"… n o [-{a}-] {{+{b}+}}"
    assert got == {(0, 1): tail("p", "q"), (0, 3): tail("p", "q"), (1, 2): tail("q", "p"), (2, 3): tail("p", "q")}


def test_word_diffs_are_dealt(spark, tmp_path, monkeypatch):
    """few bytes of texts are still many diffs: no task makes them all, and a text that all others are like is dealt into parts."""
    from rulegrain.plans import queries as Q

    tables, keep = {}, Q.settled
    monkeypatch.setattr(Q, "settled", lambda df, name: tables.setdefault(name, keep(df, name)))
    monkeypatch.setattr(SIM, "BLOCK", 16)
    one = [f"w{i}" for i in range(40)]
    texts = [" ".join(one)] + [" ".join([*one[:k], f"x{k}", *one[k + 1 :]]) for k in range(40)] + [" ".join([*one[:k], f"y{k}", *one[k + 1 :]]) for k in range(40)]
    rows = [(i, t, f"s{min(i, 1)}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["a"], r["b"]): r["diff"] for r in Q.word_diffs(spark, str(tmp_path)).collect()}
    words = [t.split() for t in texts]
    sets = {r["rule_id"]: set(r["tokens"]) for r in SIM.with_shingles(Q.doc_rules(spark, str(tmp_path))).select("rule_id", "tokens").collect()}
    like = [b for b in range(1, len(texts)) if 0.6 <= len(sets[0] & sets[b]) / len(sets[0] | sets[b]) < 0.9]
    assert got == {(0, b): diff_words(words[0], words[b]) for b in like} and len(like) > 40
    files = [r["n"] for r in tables["diffs"].groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(files) > 2 and max(files) <= 60


def test_word_diff_of_long_texts_takes_little_time():
    """rows of the table are whole numbers with a bit a word; those of long texts are made again from kept ones, with the same result."""
    import time

    rng = random.Random(10)
    a = [f"w{rng.randrange(3000)}" for _ in range(12_000)]
    b = [w if rng.random() > 0.05 else "changed" for w in a[:6000] + a[6100:]]
    start = time.process_time()
    whole = diff_words(a, b)
    assert time.process_time() - start < 0.8 and whole.count("[-") - whole.count("{+") == 100
    before, diffs.WHOLE = diffs.WHOLE, 0
    try:
        for _ in range(300):
            x, y, end = (rng.choices("abc", k=rng.randrange(12)) for _ in range(3))
            assert diff_words(x + end, y + end) == plain_diff(x + end, y + end)
    finally:
        diffs.WHOLE = before


def test_text_without_marks_is_not_searched():
    """F8: what INLINE finds has a mark, so texts without any needn't be searched."""
    from rulegrain.functions import markdown as M

    rng = random.Random(8)
    texts = ["".join(rng.choices("ab \n\\`*_[]()<>!&;:", k=rng.randrange(1, 12))) for _ in range(20_000)]
    assert all(M.MARKED.search(t) for t in texts if M.INLINE.search(t)) and not M.MARKED.search("plain text,\nof two lines!")
