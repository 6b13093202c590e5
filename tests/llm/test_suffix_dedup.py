"""Suffix-array dedup against window by window search."""

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from rulegrain.llm import suffix_dedup as sd

NONE = np.zeros(sd.SLOTS, bool)


def told(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_bytes int, starts string").repartition(4)
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in sd.suffix_dedup(df, **kw).collect()]


def random_text(rng, n, letters="abcdefghij klmno"):
    return "".join(rng.choice(letters) for _ in range(n))


def corpus(seed):
    """Exact and near copies, passages at all places, periodic texts, copies within a text, cuts through characters."""
    rng = random.Random(seed)
    bases = [random_text(rng, rng.randint(90, 700)) for _ in range(12)] + ["né€🙂" * 60, "ab" * 200, "x" * 350, random_text(rng, 50) * 6, random_text(rng, 40, "é€")]
    rows = []
    for i in range(90):
        t = rng.choice(bases)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", "z", random_text(rng, 20), rng.choice(bases)[: rng.randint(60, 140)]]) + t[at + rng.randrange(3) :]
        if rng.random() < 0.3:
            t = t + random_text(rng, 30) + t[: rng.randint(80, 200)]
        rows.append((rng.randrange(10**6) * 100 + i, t))
    return [*rows, (1, None), (2, ""), (3, "y" * 99), (4, "y" * 100), (5, "y" * 101)]


@pytest.mark.parametrize("seed", range(4))
def test_brute(spark, seed):
    rows = corpus(seed)
    want = sd.brute(pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert {r[0]: r[1:] for r in told(spark, rows, in_bytes=1 << 30 if seed % 2 else None)} == want


def test_repeated_rows_null_keys_and_empty(spark):
    rng = random.Random(9)
    a, b = random_text(rng, 300), random_text(rng, 300)
    rows = [(7, a), (7, a), (None, a), (8, a + b), (8, a + b), (9, b)]
    got = sorted(told(spark, rows), key=str)
    whole = [(d, len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for d, t in ((7, a), (7, a), (None, a))]
    rest = hashlib.sha256(b.encode()).hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    assert got == sorted([*whole, (8, 600, 300, 1, rest), (8, 600, 300, 1, rest), (9, 300, 300, 1, none)], key=str)
    assert told(spark, []) == []
    assert told(spark, [(None, None), (None, a)])[0][2] == 0


def test_one_key_with_different_texts(spark):
    """Different documents, in the order of their hashes: one of them keeps the passage."""
    rng = random.Random(3)
    p = random_text(rng, 150)
    got = told(spark, [(1, p + "first"), (1, p + "second")])
    assert sorted(r[2] for r in got) == [0, 150]


def test_a_very_long_text_and_hot_copies(spark):
    """Slices meet; a text that a third of all rows have; a line that very many different texts have."""
    rng = random.Random(5)
    long, line = random_text(rng, sd.SLICE + 5000), random_text(rng, 70)
    at = sd.SLICE - 60
    rows = [(10, long), (11, long[at : at + 130]), (12, long[-200:] + "tail")]
    rows += [(100 + i, "copy " * 40) for i in range(150)] + [(500 + i, random_text(rng, 60) + line + random_text(rng, 60)) for i in range(150)]
    assert {r[0]: r[1:] for r in told(spark, rows)} == sd.brute(pd.DataFrame(rows, columns=["doc_id", "text"]))


def test_previous_factors():
    rng = random.Random(1)
    for t in range(40):
        data = bytes(rng.choice(b"ab" if t % 2 else b"abcdefgh") for _ in range(rng.randint(100, 330)))
        data = b"a" * len(data) if t % 5 == 0 else data + data[: rng.randint(1, 150)] + data if t % 3 == 0 else data
        at = np.arange(len(data) - sd.LENGTH + 1)
        if t % 4 == 0:
            at = at[at % 3 > 0]
        want = [max((next((k for k in range(sd.LENGTH) if data[i + k] != data[j + k]), sd.LENGTH) for j in at.tolist() if j < i), default=0) for i in at.tolist()]
        assert sd.previous_factors(data, at).tolist() == want


def test_previous_smaller():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50):
        v = rng.permutation(n)
        assert sd.previous_smaller(v).tolist() == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]


def test_stretches_hold_each_window_once():
    """Whatever comes last: equal windows have equal minimisers, and one that is twice in its stretch is told."""
    rng = random.Random(2)
    parts = [random_text(rng, n).encode() for n in (100, 131, 400)] + [b"q" * 300, b"abcde" * 50]
    frequent = np.random.default_rng(0).random(sd.SLOTS) < 0.3
    for marked in (NONE, frequent):
        starts, k, low, own, twice = sd.stretches(b"".join(parts), np.array([len(p) for p in parts]), marked)
        begin = np.cumsum([0] + [len(p) for p in parts])
        windows = [(int(o), int(s - begin[o]) + i) for s, n, o in zip(starts, k, own, strict=True) for i in range(n)]
        assert windows == [(o, i) for o, p in enumerate(parts) for i in range(len(p) - sd.LENGTH + 1)]
        assert twice[own >= 3].all() and not twice[own < 3].any()


def test_marks_pack():
    rng = np.random.default_rng(4)
    doc, h = np.repeat(rng.integers(-(2**62), 2**62, 5), 3), np.repeat(rng.integers(-(2**62), 2**62, 5), 3)
    order = np.lexsort((h, doc))
    mark, start = rng.integers(0, 2**32, 15).astype(np.uint64), rng.integers(-1, 10**6, 15)
    for got, want in zip(sd.unpack_marks(sd.pack_marks(mark, doc[order], h[order], start)), (mark, doc[order], h[order], start), strict=True):
        assert got.tolist() == want.tolist()
    assert pa.types.is_binary(sd._blobs([(1, b"x")]).schema.field("packed").type)
