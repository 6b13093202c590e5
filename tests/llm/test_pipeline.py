"""The pipeline's stages, one by one, against plain versions."""

import base64
import random
import zlib

import pandas as pd
import pytest

import corpus_pipeline
from rulegrain.llm import jaccard_join, mixing, secret_scan, stages
from rulegrain.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = {"en": "the of and with this that from house water tree".split(), "de": "der die und nicht mit schön größe straße haus".split()}
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choices(words[lang], k=40)), lang, f"s{i % 3}"))
    rows += [(200 + i, rows[i][1] + (" extra" if i % 2 else ""), rows[i][2], "s0") for i in range(20)]
    rows += [(300, "12 34 --- 56", "en", "s1"), (301, rows[0][1] + " more words of the house password=hunter2hunter2", "en", "s2")]
    return spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages(spark, docs):
    before, now = docs, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = table(stage(spark, before, ""), name)
        a, b = before.toPandas(), now.toPandas()
        if k < 4:
            assert list(b.columns) == COLUMNS
        if name == "language_id":
            assert set(a.doc_id) - set(b.doc_id) == {300}
        elif name == "jaccard_join":
            want = jaccard_join.brute(a)
            assert set(b.doc_id) == {c for _, c in want.values()} and len(b) == b.doc_id.nunique() < len(a)
        elif name == "secret_scan":
            both = a.merge(b, on="doc_id")
            assert len(both) == len(a) == len(b)
            for r in both.itertuples():
                _, spans, _ = secret_scan.scan(r.text_x)
                assert r.text_y == (secret_scan.redact(r.text_x, spans) if spans else r.text_x) and r.n_chars_y == len(r.text_y)
            assert not any("hunter2" in t for t in b.text)
        elif name == "mixing":
            assert set(b.doc_id) <= set(a.doc_id) and b.groupby("doc_id").size().max() <= 3
        else:
            assert sorted(b.doc_id) == sorted(a.doc_id) and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(b.columns)
        before = now


def test_clashing_columns(spark, docs):
    more = docs.withColumn("_language", docs["doc_id"]).withColumn("lang_pred", docs["lang"])
    out = corpus_pipeline.STAGES[0][1](spark, more, "")
    assert out.columns == more.columns and isinstance(out.limit(1).toPandas(), pd.DataFrame)
    assert corpus_pipeline.STAGES[1][1](spark, docs.limit(0), "").count() == 0


def test_mix_of_rows_without_key(spark):
    rows = [(None if i % 4 else i, f"r{i} " + "w " * (i % 7), "s" if i % 3 else None) for i in range(120)] + [(8, "r1 w w", "s"), (8, "r1 w w", "s")]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = stages.mixed_sources(docs).toPandas()
    words = lambda texts: sum(len(t.split()) for t in texts)
    assert words(mixed.text) == mixing.mix(docs).toPandas().taken.sum() <= words(t for _, t, _ in rows)
    assert mixed[mixed.text != "r1 w w"].groupby("text").size().max() <= 3


def test_one_of_each_with_namesakes(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, b), (2, c), (2, c), (4, a), (1, c + " more"), (5, "--"), (5, "..."), (5, "--"), (None, a), (None, a)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in stages.one_of_each(docs).collect())
    assert kept == sorted([(0, a), (0, a), (1, a), (1, c + " more"), (2, b), (5, "--"), (5, "...")])


def test_equal_rows_of_other_columns(spark):
    """Of rows that are equal in doc_id and text the smallest stays, however they come."""
    rows = [(i % 3, f"text {i % 3} of it", "en", s, 1) for i in range(9) for s in (f"s{i}", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [sorted(map(tuple, stages.one_of_each(d).collect())) for d in (docs, docs.repartition(7), docs.orderBy("source"))]
    assert kept[0] == kept[1] == kept[2] == [(i, f"text {i} of it", "en", None, 1) for i in range(3)]


def test_empty_tables_and_hard_rows(spark, docs):
    """Every stage on no rows; and all of them with a document of many compressed streams, a very long one and repeated ones."""
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
    streams = b"\n".join(zlib.compress(f"{i} password=hunter2hunter{i:04d} end".encode()) for i in range(120))
    pdf = "the house and the tree with data:application/pdf;base64," + base64.b64encode(streams).decode() + " of this"
    rows = [(900, pdf, "en", "s0", len(pdf)), (901, "the house of and with " * 40_000, "en", None, 1), (901, "the house of and with " * 40_000, "en", None, 1), (902, None, None, None, None)]
    now = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = table(stage(spark, now, ""), name)
        if name == "secret_scan":
            (clean,) = now.filter("doc_id = 900").collect()
            assert clean["text"].startswith("the house and the tree with ") and clean["text"].count("[SECRET]") > 1 and not secret_scan.scan(clean["text"])[1]
    assert now.columns == COLUMNS
