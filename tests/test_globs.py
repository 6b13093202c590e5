"""Globs against files by keys, against each one matched with each."""

import random
import re

import pytest

from rulegrain.functions import paths as P
from rulegrain.operators import globs as G

FIXED = [
    "**/*.ts", "src/**/*.{ts,tsx}", "*", "**", "**/*", "*/*", "?", "a?c", "**/components/**", "src/**", "{a,b}/**/x.ts", "**/{x,y}.ts", "a{b{c,d},e}/f", "weird{name.ts", "x}y", "a,b", "{a/b,c}/x.ts", "a**/x.ts", "a**b", "***/x.ts", "****/b.ts", "**foo", "*foo*", "**/*oo*", "*o*", "src*/**",
    "**/.env", "**/*.", "a.b/**/c.d", "[id]/*.ts", "(g)/+page.ts", "$x^/.ts", "packages/*/src/**/*.test.ts", "**/a/**/b/*.ts", "{}", "{,a}x", "a/", "/a", "", "**/", "{a,b}{a,b}{a,b}{a,b}{a,b}{a,b}{a,b}/x.ts", "ä/**/é.ts", "\\w/*.ts", "**/*.t?", "x*y*z/**", "**/x",
]


def random_path(rng):
    names = ["a", "b", "c", "src", "components", "foo", "afoo", "x.ts", "y.ts", "x.test.ts", "abc", "x", "packages", "[id]", "(g)", "ä", "b,c}", "{a", "weird{name.ts", ".env", "a.b", "c.d", "x}y", "aax", "x1y2z", "ax.ts", "\\w", "line\nend.ts", "é.ts", "+page.ts"]
    return "/".join(rng.choices(names, k=rng.randint(1, 5)))


def random_glob(rng):
    pieces = ["a", "b", "src", "*", "**", "?", "/", "/", "/", ".ts", "{a,b}", "{x,y*}", "foo", "{", "}", ",", "x.ts", "**/", "é"]
    return "".join(rng.choices(pieces, k=rng.randint(1, 7)))


@pytest.mark.parametrize("seed", range(2))
def test_matches_are_all(spark, seed):
    rng = random.Random(seed)
    globs = FIXED + [random_glob(rng) for _ in range(400)]
    files = [random_path(rng) for _ in range(250)]
    rows = [(r, g, 1) for r in ("r", "s") for g in globs]
    index = [("r", f, "k") for f in files] + [("s", f, "k") for f in files[:50]] + [("t", "x.ts", "k"), ("r", None, "k")]
    got = G.matches(spark.createDataFrame([*rows, ("r", None, 1), *rows[:9]], "repo_id string, glob string, _key int"), spark.createDataFrame([*index, *index[:5]], "repo_id string, path string, glob string"), ["repo_id"]).collect()
    want = {(r, g, f) for r, fs in (("r", set(files)), ("s", set(files[:50]))) for g in globs for p in [re.compile(P.glob_pattern(g), re.DOTALL)] for f in fs if p.fullmatch(f)}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_kinds(spark):
    rows = [(g,) for g in ("**/*.ts", "src/**", "src/**/gen/*.ts", "**/foo/**", "**/x.ts", "*oo*", "*foo*", "**/?", "a**/x.ts")]
    got = {r["glob"]: (r["_kind"], r["_key"].replace(G.BETWEEN, " ")) for r in G.keyed(spark.createDataFrame(rows, "glob string")).collect()}
    assert got == {
        "**/*.ts": ("key", " e:ts"), "src/**": ("key", "p:src "), "src/**/gen/*.ts": ("key", "s:gen e:ts"), "**/foo/**": ("key", "s:foo "), "**/x.ts": ("key", " n:x.ts"), "*oo*": ("rest", ""), "*foo*": ("gram", "foo"),
        "**/?": ("shape", ""), "a**/x.ts": ("key", " e:ts"),
    }


def test_many_globs_without_a_directory_meet_few_files(spark):
    """No Python in the plan, and no join of all files with all globs: as many rows leave the joins as match."""
    globs = spark.range(3000).selectExpr("concat('r', id % 1) repo_id", "concat('**/', case id % 3 when 0 then concat('mod', id, '/**/*.ts') when 1 then concat('*.ext', id) else concat('name', id, '.py') end) glob")
    files = spark.range(60_000).selectExpr("concat('r', id % 1) repo_id", "concat('a', id % 7, '/mod', id % 3000, '/b/', case id % 2 when 0 then concat('f', id, '.ts') else concat('g.ext', id % 5000) end) path")
    found = G.matches(globs, files, ["repo_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    n = {r["k"]: r["count"] for r in found.selectExpr("substr(glob, 4, 3) k").groupBy("k").count().collect()}
    assert n == {"mod": 10_000, "*.e": 6000}


def test_empty(spark):
    none = spark.createDataFrame([], "repo_id string, glob string, path string")
    assert G.matches(none, none, ["repo_id"]).count() == 0
