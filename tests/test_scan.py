"""Whole scans of small repositories, and single analyzers on inline relations."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from rulegrain.operators import compliance as C
from rulegrain.operators import fixes as W
from rulegrain.operators import scoring as S
from rulegrain.plans.scan import scan
from rulegrain.sinks import reports as Rep
from rulegrain.sources import config as Conf
from rulegrain.sources import repos as Repos
from rulegrain.streaming.watch import rescan

FILES = {
    "package.json": '{"scripts": {"test": "x", "build": "y"}}', "src/index.ts": "", "src/db.ts": "", ".gitignore": "dist/\n", "dist/x.js": "",
    "AGENTS.md": "# Rules\n\n- Always use named exports in shared modules of this code base.\n- Run `npm run lint` before every commit you make.\n- See `src/gone.ts` for details about it.\n- See `src/db.ts`.\n",
    "CLAUDE.md": "# Claude\n\n- Never use named exports in shared modules here.\n- Run `npm run lint` before every commit you make.\n<!-- rulegrain-ignore -->\n- Look at `src/lost.ts` some day.\n",
    ".cursor/rules/a.mdc": "---\nglobs: src/*.ts\n---\n- Something about `~/.claude/x` that is long enough to be seen.\n", ".cursor/rules/bad.mdc": "---\nglobs: [a\n---\n- Text\n",
    ".cursorrules": "old", "packages/web/AGENTS.md": "# Web\n\n- Keep `../../src/index.ts` and `../db.ts` apart from all of the others, please.\n",
}


def make(root, files):
    for path, text in files.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repos")
    messy = make(root / "messy", FILES)
    clean = make(root / "clean", {"src/a.ts": "", "AGENTS.md": "# Title\n\n- Use strict types in every module that you add, and keep `src/a.ts` small and easy to read at all times.\n"})
    return scan(spark.createDataFrame([("messy", messy), ("clean", clean)], "repo_id string, root string"))


def test_findings(result):
    rows = [r.asDict(recursive=True) for r in result["findings"].collect()]
    by = {}
    for r in rows:
        by.setdefault((r["repo_id"], r["category"]), []).append(r)
    assert not [k for k in by if k[0] == "clean"]
    stale = sorted(r["fix"]["ref"] for r in by["messy", "stale-reference"])
    assert stale == ["../db.ts", "npm run lint", "npm run lint", "src/gone.ts"]
    assert len(by["messy", "duplication"]) == 1 and by["messy", "duplication"][0]["severity"] == "error"
    assert len(by["messy", "contradiction"]) == 1
    assert {r["message"].split(" ")[0] for r in by["messy", "load-semantics"]} == {".cursorrules", ".cursor/rules/a.mdc:4-4"}
    assert any("front matter" in r["message"] for r in by["messy", "structure"])


def test_scores_and_contexts(result):
    totals = {r["repo_id"]: r["total"] for r in result["scores"].collect()}
    assert totals["clean"] == 100 and totals["messy"] < 80
    told = {(r["repo_id"], r["tool"], r["directory"]): [e["path"] for e in r["entries"] or []] for r in result["contexts"].collect()}
    assert told["messy", "claude-code", "."] == ["CLAUDE.md", "AGENTS.md"]
    assert told["messy", "codex", "packages/web"] == ["AGENTS.md", "packages/web/AGENTS.md"]
    assert told["messy", "cursor", "."] == ["AGENTS.md", ".cursor/rules/a.mdc", ".cursor/rules/bad.mdc"]
    assert told["clean", "windsurf", "."] == []
    assert "dist/x.js" not in [r["path"] for r in result["files"].collect()]


def test_reports(result):
    told = {r["repo_id"]: Rep.read_payload(r["report"]) for r in Rep.payloads(result).collect()}
    report = told["messy"]
    assert report["score"]["total"] < 80 and report["stats"]["surfaces"] == 6
    assert {f["severity"] for f in report["findings"]} == {"error", "warn", "info"}
    sarif = json.loads(Rep.render(report, "sarif"))
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == len(report["findings"])
    assert "Context health" in Rep.render(report, "md") and "errors" in Rep.render(report, "text")
    with pytest.raises(ValueError):
        Rep.render(report, "xml")
    with pytest.raises(ValueError):
        Rep.read_payload('{"version": 1}')


def test_baseline(spark, result):
    f = result["all_findings"].filter("repo_id = 'messy'")
    known = f.select("repo_id", "fingerprint").limit(2).unionByName(spark.createDataFrame([("messy", "x"), ("messy", "y")], "repo_id string, fingerprint string"))
    kept, counts = S.apply_baseline(f, known)
    assert kept.count() + counts.first()["suppressed"] == f.count() and counts.first()["stale"] == 2


@pytest.mark.parametrize(("severities", "uniqueness", "total"), [(["error"], 75, 95), (["error"] * 5, 16, 83), (["error"] * 6, 8, 82), (["error"] * 8, 0, 80), (["error"] * 15, 0, 80), ([], 100, 100)])
def test_score_table(spark, severities, uniqueness, total):
    f = spark.createDataFrame([("r", "duplication", s) for s in severities], "repo_id string, category string, severity string")
    row = S.scores(f, spark.createDataFrame([("r",)], "repo_id string")).first()
    assert (row["uniqueness"], row["total"]) == (uniqueness, total)


def test_fixes(spark, result):
    renames = spark.createDataFrame([("messy", "src/gone.ts", ["src/db.ts"]), ("messy", "npm run lint", ["nowhere"])], "repo_id string, old string, targets array<string>")
    plan = W.plan(result["findings"], result["rules"], result["surfaces"], renames, result["index"])
    safe = [r.asDict(recursive=True) for r in plan.filter("safe").collect()]
    assert sorted(r["kind"] for r in safe) == ["delete-rule", "update-path"]
    after = {r["path"]: r["after"] for r in W.apply_plan(plan, result["surfaces"]).collect()}
    assert "src/gone.ts" not in after["AGENTS.md"] and "npm run lint" not in after["CLAUDE.md"]


def test_apply_edits():
    e = lambda t, a, b, find=None, new=None: {"type": t, "start_line": a, "end_line": b, "find": find, "replace_with": new}
    assert W.apply_edits("# T\na\n\nb\n\nc", [e("delete", 4, 4)]) == "# T\na\n\nc"
    assert W.apply_edits("# T\nx\nNEVER y", [e("move-to-top", 3, 3)]) == "# T\n\n## Critical rules\n\nNEVER y\nx"
    assert W.apply_edits("see src/u.ts and src/u.ts.orig", [e("replace", 1, 1, "src/u.ts", "lib/u.ts")]) == "see lib/u.ts and src/u.ts.orig"
    assert W.apply_edits("```\n\n\n```", []) == "```\n\n\n```"


def test_history(spark, tmp_path):
    root = make(tmp_path, {"src/old.ts": "x\n" * 30, "AGENTS.md": "a"})
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    git("mv", "src/old.ts", "src/new.ts")
    git("commit", "-qam", "two")
    repos = spark.createDataFrame([("r", root), ("none", str(tmp_path / "missing"))], "repo_id string, root string")
    assert [tuple(r) for r in Repos.renames(repos).collect()] == [("r", "src/old.ts", ["src/new.ts"])]
    changes = Repos.changes(repos)
    assert {r["repo_id"] for r in changes.filter("error is not null").collect()} == {"none"}
    chunks = C.pack_chunks(C.file_diffs(changes))
    assert chunks.filter("array_contains(files, 'AGENTS.md')").count() == 0 and chunks.count() == 2
    assert Repos.clean_tree(root) is None and Repos.clean_tree(str(tmp_path / "missing"))


def test_compliance(spark):
    rules = spark.createDataFrame([("r", "a", "Validate request bodies in src/routes/.", ["src/routes/"]), ("r", "b", "Prefer parameterized database queries", []), ("r", "c", "Nothing matches", ["lib/*.py"])], "repo_id string, rule_id string, text string, refs array<string>")
    chunks = spark.createDataFrame([("r", "1", "abc", ["src/routes/x.ts"], "diff"), ("r", "2", "abd", ["q.sql"], "parameterized database things"), ("r", "3", "abe", ["lib/a.py"], "z")], "repo_id string, chunk_id string, sha string, files array<string>, diff string")
    pairs = C.applicable(rules, chunks)
    assert sorted((r["rule_id"], r["chunk_id"]) for r in pairs.collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    full = pairs.join(rules, ["repo_id", "rule_id"]).join(chunks, ["repo_id", "chunk_id"])
    cache = spark.createDataFrame([], "rule_hash string, chunk_id string, model string, verdict string, evidence string")

    def client(prompt):
        if "lib" in prompt:
            raise RuntimeError("offline")
        return '{"verdict": "violated", "evidence": "e"}' if "routes" in prompt else "no json"

    judged = C.judge(full, cache, client, "m")
    report = {r["rule_id"]: r for r in C.rule_reports(judged).collect()}
    assert report["a"]["violated"] == 1 and report["b"]["errors"] == 1 and report["c"]["errors"] == 1
    kept = C.new_verdicts(judged)
    assert kept.count() == 1 and C.judge(full, kept, client, "m").filter("from_cache").count() == 1
    cost = C.cost(full, kept, "m", 1.0, 5.0).first()
    assert (cost["pairs"], cost["cached"], cost["output_tokens"]) == (3, 1, 400)


def test_verdicts(spark):
    rows = ['{"verdict":"followed","evidence":"ok"}', "not json", 'say {"verdict":"other"}', 'x {"verdict":"violated"} y']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(C.parse_verdict(F.col("x"))).collect()]
    assert [g and tuple(g) for g in got] == [("followed", "ok"), None, None, ("violated", "")]


def test_config():
    assert Conf.load('{"budgets": {"surfaceWarnTokens": 800}}').budgets.surface_warn_tokens == 800
    assert Conf.load(None) == Conf.Config()
    for bad in ("[]", "{", '{"x": {}}', '{"budgets": {"y": 1}}', '{"budgets": {"surfaceWarnTokens": "1"}}'):
        with pytest.raises(Conf.ConfigError):
            Conf.load(bad)
    assert Repos.exclude_globs(["test/fixtures", "docs/"]) == ["test/fixtures", "test/fixtures/**", "docs", "docs/**"]
    assert Repos.ignore_globs("# c\n/dist\nlogs/\na/b\n!x\n") == ["dist", "dist/**", "**/logs", "**/logs/**", "a/b", "a/b/**"]


def test_watch(spark, tmp_path):
    source = tmp_path / "events"
    spark.createDataFrame([("a", "x"), ("b", "y")], "repo_id string, path string").write.parquet(str(source))
    events = spark.readStream.schema("repo_id string, path string").parquet(str(source))
    roots = spark.createDataFrame([("a", "/a"), ("c", "/c")], "repo_id string, root string")
    seen = []
    q = rescan(events, roots, lambda todo: seen.extend(r["repo_id"] for r in todo.collect()), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(60)
    assert seen == ["a"]


def test_rollups(spark):
    keys = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "key string, category string")
    labels = spark.createDataFrame([("1", "tp"), ("2", "fp")], "key string, label string")
    got = {r["category"]: (r["tp"], r["fp"], r["unlabeled"], r["precision"]) for r in S.precision(keys, labels).collect()}
    assert got == {None: (1, 1, 1, 0.5), "a": (1, 1, 0, 0.5), "b": (0, 0, 1, None)}
    bad = S.corpus_problems(spark.createDataFrame([("x", "a/b", "0" * 40), ("x", "ab", "1")], "name string, repo string, sha string"))
    assert bad.count() == 3
