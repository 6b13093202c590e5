"""The filter interaction audit against document by document counting."""

import random

import pandas as pd
import pytest

from rulegrain.llm import filter_audit as fa

DOCS, LABELS = "doc_id bigint, text string, source string", "doc_id bigint, quality int, toxic int"


def texts(rng, n):
    """Texts on both sides of every threshold, copies among them."""
    fixed = [None, "", " \t", "a", "A", "#", " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), "x " * 40 + " ".join(f"y{i}" for i in range(24)), "Aa" * 9, "A" + "b" * 19, "A" + "b" * 18, "É" * 19 + "A"]
    out = []
    for _ in range(n):
        words = [rng.choice(["one", "Two", "tHREE", "four#", "x|y", "ü", "🙂"]) if rng.random() < 0.2 else f"w{rng.randrange(90)}" for _ in range(rng.randint(30, 80))]
        out.append(rng.choice(fixed) if rng.random() < 0.4 else rng.choice([" ", "\n", "\x0b "]).join(words))
    return out + rng.choices(out, k=n // 2)


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_brute(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, rng.randrange(30), None]), t, rng.choice(["a", "a", "b", None, ""])) for i, t in enumerate(texts(rng, 80))]
    rows += rng.choices(rows, k=10)  # repeated rows
    labels = [(rng.choice([rng.randrange(130), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    want = fa.brute(pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": object}), pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype(object))
    docs = spark.createDataFrame([(*r, "mask", 1) for r in rows], DOCS + ", mask string, good int").repartition(3)  # clashing names
    marks = spark.createDataFrame([(*r, "text") for r in labels], LABELS + ", source string")
    assert got(fa.filter_audit(docs, marks)) == want


def test_every_step_of_every_part_adds_up(spark):
    rows = [(i, "one text that all share" if i % 3 else f"text {i}", "s") for i in range(300)]
    out = got(fa.filter_audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)))
    assert len(out) == 600
    for order in {k[1] for k in out}:
        assert out["s", order, 5][0] + sum(out["s", order, i][1] for i in range(1, 6)) == 300
    assert sum(out["s", "ABCDE", i][6] for i in range(1, 6)) == 120 * (300 - out["s", "ABCDE", 5][0])
    assert out["s", "EABCD", 1][1] == 199  # all copies but the first


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1)], LABELS)
    assert fa.filter_audit(none, labels).count() == 0
    one = got(fa.filter_audit(spark.createDataFrame([(1, "x" * 3_000_000, None)], DOCS), labels))
    assert one["", "ABCDE", 1] == (0, 1, 0, 1, 1, 1, 120)  # one very long word: under 50 words
