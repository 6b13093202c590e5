"""Command line: scan (the default), fix, compliance and report of a local repository."""

from __future__ import annotations

import argparse
import json
import os
import re
import subprocess
import sys
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .functions.tokens import load_vocabulary
from .operators.fixes import apply_plan, plan
from .operators.scoring import gate
from .plans import compliance as J
from .plans.scan import scan
from .sinks import reports
from .sources import config as C
from .sources import repos as R
from .sources.settled import settled

BASELINE, CACHE, PLAN, VERDICTS = ".rulegrain-baseline.json", ".rulegrain/last-scan.json", "rulegrain-fixes.md", ".rulegrain/verdicts"
#: Changes below these never start a scan: they are our own outputs, or no part of the repository.
UNWATCHED = re.compile(r"(^|/)(\.git|node_modules|\.rulegrain)(/|$)|(^|/)rulegrain-fixes\.md$")
QUIET = 0.4


def _session() -> SparkSession:
    return SparkSession.builder.appName("rulegrain").config("spark.ui.enabled", "false").getOrCreate()


def _read(path: str) -> str | None:
    return open(path, encoding="utf-8").read() if os.path.exists(path) else None


def _baseline(spark: SparkSession, root: str, repo: str):
    if (text := _read(f"{root}/{BASELINE}")) is None:
        return None
    told = json.loads(text)
    if told.get("version") != 1 or not isinstance(told.get("findings"), list):
        raise C.ConfigError(f"{BASELINE} can't be read: write it anew")
    return spark.createDataFrame([(repo, f) for f in told["findings"]], "repo_id string, fingerprint string")


def _user_global(spark: SparkSession, repo: str, max_bytes: int | None) -> DataFrame | None:
    """The user's own file, which is loaded beside every repository's; None if there is none that can be read."""
    path = os.path.expanduser(R.USER_GLOBAL)
    try:
        if max_bytes is not None and os.path.getsize(path) > max_bytes:
            return None
        return spark.createDataFrame([(repo, _read(path))], "repo_id string, raw string") if os.path.isfile(path) else None
    except (OSError, UnicodeDecodeError):
        return None


def _repos(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(root, root)], "repo_id string, root string")


def _scan(spark: SparkSession, root: str, config: C.Config, a: argparse.Namespace, use_baseline: bool = True) -> dict:
    own = _user_global(spark, root, config.discovery.max_surface_bytes) if a.user_global else None
    more = {} if a.counted is None else {"vocabulary": a.counted}
    return scan(_repos(spark, root), config, own, _baseline(spark, root, root) if use_baseline else None, **more)


def _tell(text: str, output: str | None) -> None:
    if output is None:
        print(text, flush=True)
    else:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text + "\n")


def _state(root: str, output: str | None) -> dict[str, tuple[int, int]]:
    """Time and size of each file that a scan could depend on."""
    found = {}
    for folder, inner, names in os.walk(root):
        at = os.path.relpath(folder, root)
        inner[:] = [d for d in inner if not UNWATCHED.search(d)]
        for name in names:
            path, full = os.path.normpath(f"{at}/{name}"), os.path.join(folder, name)
            if not UNWATCHED.search(path) and full != output:
                try:
                    told = os.stat(full)
                except OSError:
                    continue  # gone in the meantime
                found[path] = (told.st_mtime_ns, told.st_size)
    return found


def watch(root: str, run: Callable[[], None], output: str | None = None, rounds: int | None = None) -> None:
    """Run again whenever files have changed and then stayed alone for 400 ms; changes during a run start the next one.

    run has been called once before. rounds ends the watch after so many runs more (None: never).
    """
    seen = _state(root, output)
    print("rulegrain: watching for changes, Ctrl-C to stop", flush=True)
    while rounds is None or rounds > 0:
        time.sleep(QUIET)
        now = _state(root, output)
        if now == seen:
            continue
        while True:
            time.sleep(QUIET)
            if (later := _state(root, output)) == now:
                break
            now = later
        seen = now
        try:
            run()
        except Exception as e:  # noqa: BLE001  a scan that fails must not end the watch
            print(f"rulegrain: the scan failed: {e}", file=sys.stderr)
        rounds = None if rounds is None else rounds - 1


def _number(text: str) -> int:
    if not text.isdecimal() or int(text) < 1:
        raise argparse.ArgumentTypeError("must be a positive integer")
    return int(text)


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="rulegrain")
    p.add_argument("command", nargs="?", default="scan", choices=["scan", "fix", "compliance", "report"])
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("--format", default="text", choices=sorted(reports.RENDERERS))
    p.add_argument("--output", type=os.path.abspath, help="write the report to this file")
    p.add_argument("--config", default=None)
    p.add_argument("--vocabulary", help="count tokens by this vocabulary file, instead of a quarter of the characters")
    p.add_argument("--pattern", default="o200k_base", help="how the vocabulary splits texts: gpt2, cl100k_base, o200k_base or a regular expression")
    p.add_argument("--no-user-global", dest="user_global", action="store_false", help=f"leave out {R.USER_GLOBAL}")
    p.add_argument("--ci", action="store_true")
    p.add_argument("--min-score", type=int, default=0)
    p.add_argument("--max-files", type=_number)
    p.add_argument("--write-baseline", action="store_true")
    p.add_argument("--watch", action="store_true", help="scan again whenever files change")
    p.add_argument("--write", action="store_true")
    p.add_argument("--judge", help="command that reads a prompt and writes its verdict")
    p.add_argument("--calibrate", metavar="JUDGE", help="a second such command, asked about a sample")
    p.add_argument("--commits", type=_number)
    p.add_argument("--yes", action="store_true", help="judge even if the estimate is above the cap")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    """Exit code: 0, 1 if a gate, a clean tree or the spend cap is missed, 2 for wrong use."""
    try:
        a = _arguments(argv)
    except SystemExit as e:
        return int(e.code or 0)
    root = os.path.abspath(a.root)
    try:
        if not os.path.isdir(root):
            raise C.ConfigError(f"{root} is no directory")
        if a.command == "report":
            text = _read(f"{root}/{CACHE}")
            if text is None:
                raise C.ConfigError("no scan was kept: run scan first")
            _tell(reports.render(reports.read_payload(text), a.format), a.output)
            return 0
        config = C.load(_read(a.config or f"{root}/rulegrain.json"), C.LIMITED)
        if a.max_files:
            config = replace(config, discovery=replace(config.discovery, max_files=a.max_files))
        if a.commits:
            config = replace(config, compliance=replace(config.compliance, commits=a.commits))
        a.counted = None
        if a.vocabulary:
            try:
                a.counted = load_vocabulary(a.vocabulary, a.pattern)
            except OSError as e:
                raise C.ConfigError(f"the vocabulary can't be read: {e}") from None
        spark = _session()
        if a.command == "fix":
            return _fix(spark, root, config, a)
        if a.command == "compliance":
            return _compliance(spark, root, config, a)
        code = _report(spark, root, config, a)
        if a.watch:
            watch(root, lambda: _report(spark, root, config, a), a.output)
        return code
    except KeyboardInterrupt:
        return 0
    except (C.ConfigError, ValueError) as e:
        print(f"rulegrain: {e}", file=sys.stderr)
        return 2


def _report(spark: SparkSession, root: str, config: C.Config, a: argparse.Namespace) -> int:
    """One scan: its report told and kept, its baseline written if asked for."""
    result = _scan(spark, root, config, a, not a.write_baseline)
    if a.write_baseline:
        marks = sorted({r["fingerprint"] for r in result["all_findings"].select("fingerprint").collect()})
        with open(f"{root}/{BASELINE}", "w", encoding="utf-8") as f:
            f.write(json.dumps({"version": 1, "findings": marks}, indent=2) + "\n")
    text = reports.payloads(result).first()["report"]
    os.makedirs(f"{root}/.rulegrain", exist_ok=True)
    with open(f"{root}/{CACHE}", "w", encoding="utf-8") as f:
        f.write(text)
    _tell(reports.render(reports.read_payload(text), a.format), a.output)
    passed = gate(result["findings"], result["scores"], a.min_score, a.ci).first()["passed"]
    return int(not passed)


def _client(command: str) -> Callable[[str], str]:
    def ask(prompt: str) -> str:
        return subprocess.run(command, shell=True, input=prompt, capture_output=True, text=True, check=True).stdout  # noqa: S602  the user's own command

    return ask


def _compliance(spark: SparkSession, root: str, config: C.Config, a: argparse.Namespace) -> int:
    """Judge the last commits by the user's rules; verdicts are kept for the next run."""
    if not a.judge:
        raise C.ConfigError("compliance needs --judge, a command that reads a prompt and writes its verdict")
    result = _scan(spark, root, config, a, False)
    kept = J.read_cache(spark, f"{root}/{VERDICTS}")
    second = _client(a.calibrate) if a.calibrate else None
    outcome = J.compliance(_repos(spark, root), result["rules"], result["surfaces"], _client(a.judge), kept, config, a.yes, second, kept, vocabulary=a.counted)
    J.keep_verdicts(outcome, f"{root}/{VERDICTS}")
    _tell(J.as_text(outcome, config.compliance.agreement_warn_threshold), a.output)
    return int(outcome.status == "over-cap")


def _fix(spark: SparkSession, root: str, config: C.Config, a: argparse.Namespace) -> int:
    """Show the plan; with --write, apply safe fixes to a clean tree and tell the scores before and after."""
    result = _scan(spark, root, config, a)
    fixes = settled(plan(result["findings"], result["rules"], result["surfaces"], R.renames(_repos(spark, root)), settled(result["index"], "index")), "fixes")
    rows = [r.asDict(recursive=True) for r in fixes.collect()]  # one repository's
    score = result["scores"].first()["total"]
    if a.write and (why := R.clean_tree(root)):
        print(f"nothing was written: {why}", file=sys.stderr)
        return 1
    edited = apply_plan(fixes, result["surfaces"]).collect()
    for r in edited:
        print(r["diff"])
        if a.write:
            with open(f"{root}/{r['path']}", "w", encoding="utf-8") as f:
                f.write(r["after"])
    if a.write and edited:
        after = _scan(spark, root, config, a)["scores"].first()["total"]
        print(f"score: {score} before, {after} after {len(edited)} file(s) changed")
    with open(f"{root}/{PLAN}", "w", encoding="utf-8") as f:
        f.write(reports.fixes_markdown(rows, score, root))
    return 0


if __name__ == "__main__":
    sys.exit(main())
