"""Token counts against the libraries of the vocabularies' own."""

import base64
import os
import pickle
import random

import pytest

from rulegrain.functions import tokens as T
from rulegrain.operators.budget import budget
from rulegrain.operators.compliance import pack_chunks

public = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
ODD = [
    "", " ", "Hello, world! It's 2024-05-06.", "a" * 3000, "-" * 700, " " * 400 + "x", "  x\u0085y​z", "é日本語 русский עברית", "👩‍👩‍👧 🇩🇪", "don't DON'T we'll ſs", "\n\n\t code();\r\n", "1234567 ١٢٣ ½ ²", "é ä", "<|endoftext|> text", "x\x00y\x1cz",
]


def texts(n=300):
    rng = random.Random(4)
    return ODD + ["".join(rng.choices("ab the THE é日 '\n\t 19.,!s-_ ́😀x́́", k=rng.randint(1, 60))) for _ in range(n)]


def told(spark, rows, vocabulary):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "id int, text string, tokens string, _n int").repartition(3)
    return {r["id"]: r["tokens"] for r in T.token_counts(df, ["id"], "text", vocabulary).collect()}


@pytest.fixture(scope="module")
def gpt2():
    return T.load_vocabulary(public.path("byte_bpe_50k.json"))


def library(name, pattern):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name, pattern", [("byte_bpe_50k.tiktoken", "gpt2"), ("byte_bpe_multi_50k.tiktoken", "o200k_base"), ("byte_bpe_multi_50k.tiktoken", "cl100k_base")])
def test_counts_are_the_librarys(spark, name, pattern):
    lib, vocabulary = library(name, T.PATTERNS[pattern]), T.load_vocabulary(public.path(name), pattern)
    want = [len(lib.encode_ordinary(t)) for t in texts()]
    assert list(map(T.Counter(vocabulary), texts())) == want
    assert told(spark, texts(), vocabulary) == dict(enumerate(want))


def test_json_vocabularies(spark, gpt2):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    assert told(spark, texts(), gpt2) == {i: len(e) for i, e in enumerate(lib.encode_batch(texts(), add_special_tokens=False))}
    with pytest.raises(ValueError):
        T.load_vocabulary(public.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        T.load_vocabulary(public.path("piece_bpe_32k.model"))
    assert pickle.loads(pickle.dumps(gpt2)).ranks == gpt2.ranks


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_whole_pages(spark, gpt2):
    lib = library("byte_bpe_50k.tiktoken", T.PATTERNS["gpt2"])
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["tokens"] for r in T.token_counts(pages, ["page_id"], "html", gpt2).collect()}
    assert got == {r["page_id"]: len(lib.encode_ordinary(r["html"] or "")) for r in pages.collect()}


def test_nulls_repeated_keys_and_empty(spark, gpt2):
    df = spark.createDataFrame([(1, "Hello there"), (1, "Hello"), (2, None), (3, ""), (None, "Hello")], "id int, text string")
    assert sorted((r["id"] or 0, r["tokens"]) for r in T.token_counts(df, ["id"], "text", gpt2).na.fill(0, ["id"]).collect()) == [(0, 1), (1, 3), (2, 0), (3, 0)]
    assert T.token_counts(df.limit(0), ["id"], "text", gpt2).count() == 0
    assert T.merged(b"ab" * 200_000, gpt2) > 1  # a long piece takes its length times a logarithm


SURFACES = "repo_id string, surface_id string, path string, kind string, scope string, tools array<string>, raw string, tokens_est int"


def test_budgets_by_a_vocabulary(spark, gpt2):
    """Findings follow the counts: many characters of few tokens are no finding, few characters of many tokens are one."""
    few, many = "the house " * 700, "".join(chr(0x4E00 + 37 * i % 20000) for i in range(1200))
    rows = [("r", "a", "AGENTS.md", "agents-md", "repo-root", ["codex"], few, -(-len(few) // 4)), ("r", "b", "CLAUDE.md", "claude-md", "repo-root", [], many, -(-len(many) // 4))]
    surfaces = spark.createDataFrame(rows, SURFACES)
    rules = spark.createDataFrame([], "repo_id string, surface_id string, rule_id string, ord int, start_line int, kind string, text string")
    contexts = spark.createDataFrame([], "repo_id string, tool string, directory string, entries array<struct<path:string,tokens_est:int,surface_id:string,conditional:boolean>>, tokens_always bigint")
    found = lambda s: {r["surface_ids"][0] for r in budget(s, rules, contexts).collect()}
    assert found(surfaces) == {"a"}
    counted = T.with_estimates(surfaces, gpt2)
    assert counted.columns == surfaces.columns and counted.schema == surfaces.schema and found(counted) == {"b"}


def test_exact_counts(spark):
    """Each distinct text is asked for once; one that fails is left open."""
    calls = spark.sparkContext.accumulator(0)

    def count(text):
        calls.add(1)
        if text == "bad":
            raise RuntimeError("no answer")
        return len(text)

    rows = [("r", str(i), "p", "k", "s", [], t, 1) for i, t in enumerate(["one", "one", "four", "bad", None])]
    got = T.exact_counter(count, attempts=2)(spark.createDataFrame(rows, SURFACES))
    assert {r["surface_id"]: r["tokens_exact"] for r in got.collect()} == {"0": 3, "1": 3, "2": 4, "3": None, "4": None}
    got.collect()
    assert calls.value == 4  # one, four, and bad twice


def test_chunks_by_a_vocabulary(spark, gpt2):
    count = T.Counter(gpt2)
    diffs = spark.createDataFrame([("r", 0, "sha", i, f"f{i}", "word " * 30 + "\n") for i in range(6)], "repo_id string, ord int, sha string, pos int, file string, diff string")
    packed = pack_chunks(diffs, 100, count).collect()
    assert [len(r["files"]) for r in packed] == [3, 3] and all(r["tokens_est"] <= 100 for r in packed) and packed[0]["tokens_est"] == 3 * count("word " * 30 + "\n")
