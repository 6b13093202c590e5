"""The compliance flow on a small history, with fake judges."""

import subprocess

from rulegrain.plans.compliance import as_text, compliance, keep_verdicts, read_cache
from rulegrain.plans.scan import scan
from rulegrain.sources.config import Config


def test_flow(spark, tmp_path):
    (tmp_path / "src/routes").mkdir(parents=True)
    (tmp_path / "AGENTS.md").write_text("# T\n\n- Always validate request bodies in src/routes/ with the schema.\n- Never touch the payments ledger by hand.\n")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "src/routes/a.ts").write_text("export const a = 1\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    repos = spark.createDataFrame([("r", str(tmp_path))], "repo_id string, root string")
    found = scan(repos)
    out = compliance(repos, found["rules"], found["surfaces"], lambda p: '{"verdict": "violated", "evidence": "const a"}', second=lambda p: '{"verdict": "followed"}')
    assert out.status == "ok" and out.pairs.count() == 1 and out.new_verdicts[0].count() == 1
    assert [r["violated"] for r in out.reports.collect()] == [1] and out.agreement.first()["agreement"] == 0.0
    told = as_text(out)
    assert "violated 100%" in told and "payments ledger" in told and "directions only" in told
    assert compliance(repos, found["rules"].limit(0), found["surfaces"], str).status == "no-rules"
    bare = spark.createDataFrame([("r", str(tmp_path / "none"))], "repo_id string, root string")
    assert compliance(bare, found["rules"], found["surfaces"], str).status == "no-git"
    cheap = compliance(repos, found["rules"], found["surfaces"], str, price=(1e9, 1e9), config=Config())
    assert cheap.status == "over-cap" and cheap.judged is None


def test_kept_verdicts_and_prices(spark, tmp_path):
    root, kept = tmp_path / "repo", str(tmp_path / "kept")
    root.mkdir()
    (root / "AGENTS.md").write_text("# T\n\n- Always validate request bodies with the schema validator.\n")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (root / "a.ts").write_text("const schema = validator(request)\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    repos = spark.createDataFrame([("r", str(root))], "repo_id string, root string")
    found = scan(repos)
    flow = lambda client, **more: compliance(repos, found["rules"], found["surfaces"], client, cache=read_cache(spark, kept), **more)
    assert read_cache(spark, kept).count() == 0
    first = flow(lambda p: '{"verdict": "followed"}')
    keep_verdicts(first, kept)
    assert first.usd > 0 and read_cache(spark, kept).count() == 1
    again = flow(lambda p: 1 / 0)  # nobody is asked
    assert again.usd == 0 and [r["from_cache"] for r in again.judged.collect()] == [True] and again.new_verdicts[0].count() == 0
    dear = flow(lambda p: "", second=lambda p: "", prices={"second-judge": (1e9, 1e9)})  # the second judge alone passes the cap
    assert dear.status == "over-cap" and dear.usd > 1
    assert flow(lambda p: "", second=lambda p: "", prices={"second-judge": (0.0, 0.0)}).status == "ok"
