"""Seeded defects are found again, and the command line runs on a repository."""

import json

import pytest
from pyspark.sql import functions as F

from rulegrain import cli
from rulegrain.operators import seeding
from rulegrain.operators.scoring import recall
from rulegrain.operators.similarity import duplication


@pytest.mark.parametrize(("count", "n"), [(10, 3), (3, 12), (7, 7), (100, 12)])
def test_spread_sample(spark, count, n):
    rows = spark.createDataFrame([("r", i) for i in range(count)], "repo_id string, i int")
    want = sorted({i * count // n for i in range(n)}) if count > n else list(range(count))
    assert sorted(r["i"] for r in seeding.spread_sample(rows, n, ["i"]).collect()) == want


def test_planted_copies(spark):
    text = "Always validate every request body in the routes folder with the shared schema helper before it reaches a handler and log failures"
    rules = spark.createDataFrame([("r", "a", "s1", 1, text, 1, 1), ("r", "b", "s1", 2, "Too short to count", 2, 2)], "repo_id string, rule_id string, surface_id string, ord int, text string, start_line int, end_line int")
    surfaces = spark.createDataFrame([("r", "s1", "AGENTS.md", ["codex"]), ("r", "seeded", "CLAUDE.md", ["claude-code"])], "repo_id string, surface_id string, path string, tools array<string>")
    for verbatim, category in ((True, "duplication"), (False, "drift")):
        copies = seeding.planted(rules, verbatim)
        assert copies.count() == 1 and (copies.first()["text"] == text) is verbatim
        found = duplication(rules.unionByName(copies), surfaces)
        hit = seeding.caught(copies.withColumn("defect", F.lit(category)), found, [category])
        got = {r["defect"]: r["recall"] for r in recall(hit).collect()}
        assert got[None] == (1.0 if verbatim or found.count() else 0.0)


def test_targets_go(spark):
    files = spark.createDataFrame([("r", "a.ts"), ("r", "b.ts")], "repo_id string, path string")
    targets = spark.createDataFrame([("r", ["a.ts"])], "repo_id string, targets array<string>")
    assert [r["path"] for r in seeding.without_targets(files, targets).collect()] == ["b.ts"]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "nobody"))
    (tmp_path / "AGENTS.md").write_text("# T\n\n- See `src/gone.ts` for all the details that you could ever want about it, and then some more.\n")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("")
    assert cli.main(["scan", str(tmp_path), "--ci"]) == 1
    assert "src/gone.ts" in capsys.readouterr().out
    assert cli.main(["scan", str(tmp_path), "--write-baseline", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["version"] == 2
    assert cli.main(["scan", str(tmp_path), "--ci"]) == 0
    assert cli.main(["report", str(tmp_path), "--format", "sarif"]) == 0
    assert cli.main(["scan", str(tmp_path / "missing")]) == 2
