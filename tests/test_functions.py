"""Truth tables of text, path, reference and Markdown functions."""

import time

import pytest
from pyspark.sql import functions as F

from rulegrain.functions import markdown as M
from rulegrain.functions import paths as P
from rulegrain.functions import references as R
from rulegrain.functions import text as T
from rulegrain.functions.diffs import diff_words, unified_diff


def values(spark, rows, **columns):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [tuple(r) for r in df.select(*[c(F.col("x")).alias(n) for n, c in columns.items()]).collect()]


def test_words_and_polarity(spark):
    rows = ["Use `src/a.ts`, ALWAYS... don't -x-", "", "Never use named exports.", "When you want more, use less.", "Exceptions: use it", "éno x"]
    got = values(spark, rows, words=T.normalize_words, polarity=T.polarity, exception=T.is_scoped_exception)
    assert got[0][0] == ["use", "src/a.ts", "always", "don", "t", "x"]
    assert got[1] == ([], "none", False)
    assert got[2][1:] == ("negative", False)
    assert got[3][2] and got[4][2]
    assert got[5][1] == "none" or got[5][1] == "negative"  # ASCII boundaries


def test_core_and_kinds(spark):
    got = values(spark, ["Always use named exports in shared modules.", "A long enough sentence about nothing at all.", "Keep it", "short"], core=T.directive_core, kind=lambda c: T.classify_rule(c, F.lit(0)))
    assert "named exports" in got[0][0] and "use named" in got[0][0]
    assert [g[1] for g in got] == ["imperative", "context", "imperative", "unknown"]


@pytest.mark.parametrize(("glob", "path", "hit"), [
    ("src/**/*.{ts,tsx}", "src/a/b.tsx", True), ("src/**/*.{ts,tsx}", "src/b.ts", True), ("src/**/*.{ts,tsx}", "src/a/b.js", False), ("weird{name.ts", "weird{name.ts", True),
    ("*.test.ts", "a/b/x.test.ts", True), ("a/*", "a/b/c", False), ("a/**", "a/b/c", True), ("{a,{b,c}}/x", "c/x", True), ("a?c/x", "abc/x", True),
])
def test_globs(glob, path, hit):
    assert P.glob_matches(glob, path) is hit


def test_resolve(spark):
    assert [v[0] for v in values(spark, ["a/./b/../c", "../x", "a/..", "./a//b"], p=P.resolve)] == ["a/c", None, "", "a/b"]
    assert values(spark, ["a/b", "."], c=P.chain) == [(["a/b", "a", "."],), (["."],)]


def test_references():
    assert R.references("see `./native-request`, run `npm test` and `yarn run build:x`", ["./native-request", "npm test", "yarn run build:x"]) == ["./native-request", "npm run build:x", "npm run test"]
    assert R.references("Do not create files like `src/x.ts`.", ["src/x.ts"]) == []
    assert R.references("Create the definition in src/tools/ please", []) == ["src/tools/"]
    assert R.references("`old/x.ts` no longer exists", ["old/x.ts"]) == []
    assert R.references("when `.pr/` exists, stop", [".pr/"]) == []
    for token in ("node_modules/x", "foo/index.ts", ".proto", "Schema.Json", "kebab-case.ts", "https://x.y/z", "1/2", "/abs/x", ".env", "a/.../b.ts"):
        assert R.references(f"see `{token}`", [token]) == [], token


def test_markdown_blocks():
    source = "# One\n\n### Three\n\n- Use `a/b.ts`\n  more\n- two\n\npara *one*\nline two [l](docs/x.md)\n\n```bash\nnpm run x\n```\n\n```js\nno()\n```\n> quoted\n\n<div>\nhtml\n</div>\n\n---\nend\n"
    rules = M.rules(source, "s")
    assert [(r["text"], r["section"], r["start_line"], r["end_line"]) for r in rules] == [
        ("Use `a/b.ts` more", ["One", "", "Three"], 5, 6), ("two", ["One", "", "Three"], 7, 7), ("para one line two l", ["One", "", "Three"], 9, 10), ("npm run x", ["One", "", "Three"], 12, 14),
        ("quoted", ["One", "", "Three"], 19, 19), ("end", ["One", "", "Three"], 26, 26),
    ]
    assert rules[2]["refs"] == ["docs/x.md"] and rules[3]["command"]


def test_rule_identity_and_nesting():
    ids = [r["rule_id"] for r in M.rules("- same\n- same\n- other\n", "s")]
    assert ids[1] == ids[0] + ".2" and not ids[2].endswith(".2")
    start = time.time()
    M.rules("> " * 500 + "deep\n", "s")
    assert time.time() - start < 2


def test_front_matter():
    rules, meta = M.parse_surface(".cursor/rules/a.mdc", "cursor-rule", "s", "---\nglobs: *.ts, src/{a,b}/*\nalwaysApply: false\n---\n# T\n\n- rule one\n")
    assert meta["globs"] == ["*.ts", "src/{a,b}/*"] and meta["always_apply"] is False and meta["frontmatter_error"] is None
    assert rules[0]["start_line"] == 7
    _, meta = M.parse_surface(".cursor/rules/a.mdc", "cursor-rule", "s", "---\nglobs: [a\n---\nbody\n")
    assert meta["frontmatter_error"]
    _, meta = M.parse_surface("x/SKILL.md", "skill", "s", "---\nname: yes\ndescription: d\n---\nbody\n")
    assert meta["description"] == "d"


def test_diffs():
    assert diff_words("a b c d e f g".split(), "a b c x e f g".split()) == "… b c [-d-] {+x+} e f …"
    assert diff_words([], ["a"]) == "{+a+}" and diff_words(["a"], ["a"]) == "…"
    assert unified_diff("f", "a\nb\nc", "a\nx\nc") == "--- a/f\n+++ b/f\n@@ -2,1 +2,1 @@\n-b\n+x"
    assert unified_diff("f", "a", "a").endswith("(no changes)")


def test_words_are_runs_with_trimmed_ends(spark):
    """The one pattern of words against cutting, trimming and leaving out, on texts of all kinds of marks."""
    import re

    def plain(text):
        runs = re.split(r"[^\w/*.@-]+|_+", text.lower().replace("`", " "))
        return [w for w in (re.sub(r"^[.-]+|[.-]+$", "", r) for r in runs) if w]

    marks = ["a.", "-b-", "..", "c.d", "@e/*", "`f`", " ", "g--h", "1.", "é-", "_x_", "...-", "A\n", "", "." * 5000 + "z"]
    texts = [a + b + c for a in marks for b in marks for c in marks[:8]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalize_words(F.col("t")).alias("w")).collect()
    assert all(r["w"] == plain(texts[r["i"]]) for r in rows) and len(rows) == len(texts)
    assert spark.range(1).select(T.normalize_words(F.lit(None).cast("string")).alias("w")).first()["w"] is None


def test_mean_overlap_counts_copies(spark):
    """Classes of equal texts against all pairs; texts without words are like nothing."""
    from itertools import combinations

    from rulegrain.operators.similarity import with_shingles
    from rulegrain.operators.structure import mean_overlap

    texts = ["one two three four five six", "one two three four five six", "One two three four five, six!", "one two three four five seven", "", "", "other words here"]
    sets = with_shingles(spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)] + [("alone", 9, "x")], "repo_id string, id int, text string"))
    grams = []
    for t in texts:
        w = "".join(c for c in t.lower() if c not in ",!").split()
        grams.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} - {()})
    pairs = [len(a & b) / len(a | b) if a | b else 0.0 for a, b in combinations(grams, 2)]
    got = {r["repo_id"]: r for r in mean_overlap(sets.select("repo_id", "id", "n", "words")).collect()}
    assert got["r"]["files"] == 7 and abs(got["r"]["mean"] - sum(pairs) / len(pairs)) < 1e-12 and got["alone"]["mean"] == 0.0


def test_keywords_shared(spark):
    from rulegrain.operators.compliance import by_keywords

    rules = spark.createDataFrame([("r", "a", "alpha beta gamma"), ("r", "b", "alpha the of"), ("r", "c", None)], "repo_id string, rule_id string, text string")
    chunks = spark.createDataFrame([("r", "1", "alpha alpha beta"), ("r", "1", "alpha alpha beta"), ("r", "2", "alpha alpha"), ("r", "3", None), ("s", "4", "alpha beta")], "repo_id string, chunk_id string, diff string")
    assert [tuple(r) for r in by_keywords(rules, chunks).collect()] == [("r", "a", "1")]
