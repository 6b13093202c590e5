"""The source divergence audit against term by term sums."""

import random

import numpy as np
import pandas as pd
import pytest

from rulegrain.llm import divergence as dv

COLUMNS = ["lang", "source", "text"]


def told(spark, rows):
    df = spark.createDataFrame([(i, *r, i) for i, r in enumerate(rows)], "doc_id bigint, lang string, source string, text string, n int").repartition(3)
    return [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in dv.divergence(df).collect()]


def check(spark, rows):
    got = told(spark, rows)
    assert len(set(got)) == len(got)
    assert set(got) == dv.brute(pd.DataFrame(rows, columns=COLUMNS))
    return got


@pytest.mark.parametrize("seed", range(3))
def test_brute(spark, seed):
    """Common and rare terms, in one and in all sources; nulls; one hot source; groups without terms."""
    rng = random.Random(seed)
    common = [f"c{chr(97 + i)}" for i in range(8)] + ["É", "日本", "Ab"]
    own = {s: [f"s{chr(97 + s)}{chr(97 + j)}" for j in range(6)] for s in range(9)}
    rows = []
    for _ in range(700):
        s = 0 if rng.random() < 0.4 else rng.randrange(9)
        words = rng.choices(common, k=rng.randint(0, 6)) + rng.choices(own[s] + own[(s + 1) % 9][:2], k=rng.randint(0, 5))
        words = [w.upper() if w.isascii() and rng.random() < 0.3 else w for w in words]
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice([f"src{s}", f"src{s}", f"src{s}", None]), rng.choice([" ", "-", "\x00", "1"]).join(words)))
    rows += [("fr", "a", "alone"), ("en", "empty", None), ("en", "void", "123"), (None, None, None)]
    rows += rng.choices(rows, k=40)
    got = check(spark, rows)
    assert {r[2] for r in got} == {"pair", "term"}


def test_many_sources_meet_block_by_block(spark):
    """More sources than a tile's side, light lists among heavy ones."""
    n = dv.BLOCK + 44
    rows = [("x", f"s{i % n}", " ".join(["all"] * (i % 5) + [f"t{chr(97 + i % n // 13)}", "some" if i % 3 else "other"])) for i in range(3 * n)]
    check(spark, rows)


def test_ties_and_empty(spark):
    assert told(spark, []) == []
    assert told(spark, [("en", "a", "few words")]) == []  # one source, no term in ten documents
    rows = [("en", s, "word") for s in ("b", "a", "é", "Z") for _ in range(10)]
    pairs = {(r[1], r[3], r[5]): r[4] for r in check(spark, rows)}
    assert pairs["a", "Z", 1] == 0 and pairs["a", "b", 2] == 0 and pairs["a", "é", 3] == 0


def test_terms_of_slices(monkeypatch):
    monkeypatch.setattr(dv, "SLICE", 16)
    text = ("Ärger über-all AND no1where " * 20).encode()
    assert [w for part in dv.terms(text) for w in part] == text.translate(dv.LETTERS).split()


def test_apart_is_exact():
    rng = np.random.default_rng(0)
    p, q = rng.integers(1, 10**9 + 2, (2, 1000))
    p[:2], q[:2] = [10**9 + 1, 1], [1, 10**9 + 1]
    assert dv.apart(p, q).tolist() == [(int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(p, q, strict=True)]


def test_shares_beyond_64_bits(spark):
    n, total, v = 4 * 10**12, 9 * 10**12 + 7, 10**6
    df = spark.createDataFrame([(n, total, v)], "n bigint, total bigint, vocabulary bigint")
    assert df.select(dv.share("n", "total")).first()[0] == 1 + dv.SCALE * (n + 2) // (total + 2 * v)
