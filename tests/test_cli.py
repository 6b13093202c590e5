"""The command line on small repositories: a user's own file, watching, judging, fixing."""

import json
import subprocess
import threading
import time

import pytest

from rulegrain import cli
from rulegrain.functions import markdown as M

RULE = "- Always use named exports in shared modules of this code base, `src/a.ts` among them.\n"
JUDGE = """sh -c 'cat > /dev/null; echo "{\\"verdict\\": \\"followed\\", \\"evidence\\": \\"e\\"}"'"""


@pytest.fixture
def root(tmp_path, monkeypatch):
    home, repo = tmp_path / "home", tmp_path / "repo"
    (home / ".claude").mkdir(parents=True)
    (home / ".claude/CLAUDE.md").write_text("# Mine\n\n- Prefer short answers wherever you can give them.\n")
    (repo / "src").mkdir(parents=True)
    (repo / "src/a.ts").write_text("")
    (repo / "AGENTS.md").write_text("# T\n\n" + RULE)
    monkeypatch.setenv("HOME", str(home))
    return repo


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


def test_user_global(spark, root, monkeypatch):
    given = []

    def scan(repos, config, user_global, baseline):
        given.append(user_global and [r["raw"] for r in user_global.collect()])
        raise ValueError("seen")

    monkeypatch.setattr(cli, "scan", scan)
    for more in ([], ["--no-user-global"]):
        assert cli.main(["scan", str(root), *more]) == 2
    (root.parent / "home/.claude/CLAUDE.md").write_bytes(b"\xff")
    assert cli.main(["fix", str(root)]) == 2
    assert [g and g[0][:6] for g in given] == ["# Mine", None, None]
    assert cli.main(["scan", str(root), "--max-files", "0"]) == 2


def test_watch(root, tmp_path):
    out, runs = str(root / "out.txt"), []

    def change():
        time.sleep(1)
        (root / "rulegrain-fixes.md").write_text("x")  # own outputs start nothing
        (root / "out.txt").write_text("x")
        time.sleep(1)
        runs.append("changed")
        (root / "src/b.ts").write_text("")

    t = threading.Thread(target=change)
    t.start()
    cli.watch(str(root), lambda: runs.append("ran"), out, rounds=1)
    t.join()
    assert runs == ["changed", "ran"]


def test_compliance(spark, root, capsys, monkeypatch):
    known, scan = {}, cli._scan
    monkeypatch.setattr(cli, "_scan", lambda *a: known.setdefault("scan", known.get("scan") or scan(*a)))  # one scan serves both runs
    assert cli.main(["compliance", str(root)]) == 2
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    (root / "src/a.ts").write_text("export const a = 1\n")
    git(root, "commit", "-qam", "two")
    capsys.readouterr()
    assert cli.main(["compliance", str(root), "--judge", JUDGE, "--commits", "5"]) == 0
    assert "followed 100%" in capsys.readouterr().out
    # kept verdicts: a judge that fails isn't asked
    assert cli.main(["compliance", str(root), "--judge", "false", "--commits", "5"]) == 0
    assert "followed 100%" in capsys.readouterr().out


def test_fix_tells_scores(spark, root, capsys):
    (root / "CLAUDE.md").write_text("# C\n\n" + RULE)
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    assert cli.main(["fix", str(root), "--write"]) == 0
    assert "score: " in capsys.readouterr().out
    left = [(root / f).read_text().count("named exports") for f in ("AGENTS.md", "CLAUDE.md")]
    assert sorted(left) == [0, 1]


def test_front_matter_in_full():
    raw = "---\nname: deploy\ndescription: d\nallowed-tools: [Read, Bash]\nsince: 2024-01-02\n---\n# T\n"
    _, meta = M.parse_surface(".claude/skills/deploy/SKILL.md", "skill", "s", raw)
    assert json.loads(meta["front_matter"]) == {"name": "deploy", "description": "d", "allowed-tools": ["Read", "Bash"], "since": "2024-01-02"}
    assert M.parse_surface("AGENTS.md", "agents-md", "s", raw)[1]["front_matter"] is None


def test_vocabulary(root, capsys):
    """Token counts of a report are the vocabulary's; a file that is none is wrong use."""
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    assert cli.main(["scan", str(root), "--no-user-global", "--format", "json", "--vocabulary", path, "--pattern", "gpt2"]) == 0
    surfaces = json.loads(capsys.readouterr().out)["surfaces"]
    from rulegrain.functions.tokens import Counter, load_vocabulary

    count = Counter(load_vocabulary(path))
    assert [(s["path"], s["tokensEstimated"]) for s in surfaces] == [("AGENTS.md", count("# T\n\n" + RULE))]
    assert cli.main(["scan", str(root), "--vocabulary", str(root / "none")]) == 2
    assert cli.main(["scan", str(root), "--vocabulary", public.path("piece_bpe_32k.model")]) == 2
