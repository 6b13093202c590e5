"""Repositories as relations: file trees, surfaces, scripts, history. Each repository is walked by one task."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import paths as P
from ..functions import text as T
from ..operators.ranks import with_ranks
from ..schema import META, finding
from .settled import settled

# Files that are surfaces, and folders that are never walked.
SURFACE_GLOBS = [
    "**/AGENTS.md", "**/CLAUDE.md", "**/.cursor/rules/*.mdc", ".github/copilot-instructions.md", "**/.cursorrules", "**/.windsurfrules", "**/.windsurf/rules/*.md", "**/.claude/skills/*/SKILL.md",
]
NEVER_WALKED = frozenset([".git", "node_modules", ".rulegrain"])
AGENTS_TOOLS = ("claude-code", "cursor", "copilot", "codex", "generic-agents-md")
USER_GLOBAL = "~/.claude/CLAUDE.md"

TREE = "repo_id string, path string, length bigint, content binary"


def ignore_globs(gitignore: str) -> list[str]:
    """Globs of a root .gitignore: anchored or slashed lines from the root, others anywhere; negated lines don't count."""
    out = []
    for line in map(str.strip, gitignore.split("\n")):
        bare = line.removeprefix("/").removesuffix("/")
        if bare and line[0] not in "#!":
            at = bare if line[0] == "/" or "/" in bare else f"**/{bare}"
            out += [at, f"{at}/**"]
    return out


def exclude_globs(exclude: list[str] | tuple[str, ...]) -> list[str]:
    """Globs of excluded surfaces; a bare path excludes what is below it too."""
    out = []
    for bare in (x.removesuffix("/") for x in exclude):
        if bare:
            out += [bare] if re.search(r"[*?\[\]{}()!]", bare) else [bare, f"{bare}/**"]
    return out


def _walk(root: str) -> Iterator[str]:
    """Relative paths of files, in order, without links."""
    todo = [""]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            continue
        todo += [f"{folder}{e.name}/" for e in reversed(entries) if e.is_dir(follow_symlinks=False) and e.name not in NEVER_WALKED]
        yield from (f"{folder}{e.name}" for e in entries if e.is_file(follow_symlinks=False))


def tree(repos: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """repo_id, path, length, content of repositories (repo_id, root); content only of surfaces, manifests and .gitignore within the limit.

    Roots are read where the task runs: they must be on storage that executors see. What .gitignore covers is left out.
    """
    wanted = re.compile("|".join(f"(?:{P.glob_pattern(g)})" for g in [*SURFACE_GLOBS, "**/package.json", ".gitignore"]) + r"\Z")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for repo, root in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
                        globs = ignore_globs(f.read())
                except OSError:
                    globs = []
                hidden = re.compile("|".join(f"(?:{P.glob_pattern(g)})" for g in globs) + r"\Z") if globs else None
                rows = []
                for path in _walk(root):
                    if hidden and hidden.match(path):
                        continue
                    size, content = os.path.getsize(full := os.path.join(root, path)), None
                    if wanted.match(path) and (max_bytes is None or size <= max_bytes):
                        with open(full, "rb") as f:
                            content = f.read()
                    rows.append((repo, path, size, content))
                    if len(rows) >= 1000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["repo_id", "path", "length", "content"])

    return repos.select("repo_id", "root").repartition("repo_id").mapInArrow(read, TREE)


def file_index(tree_rows: DataFrame, max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """repo_id, path of up to max_files files (None: all) of each repository, in order of path; and repo_id of those that had more."""
    if max_files is None:
        return tree_rows.select("repo_id", "path"), tree_rows.select("repo_id").limit(0)
    n = tree_rows.groupBy("repo_id").agg(F.count("*").alias("n"))
    over = n.filter(F.col("n") > max_files).select("repo_id")
    cut = with_ranks(tree_rows.select("repo_id", "path").join(over, "repo_id"), ["repo_id"], [F.col("path")]).filter(F.col("rank") < max_files)
    return tree_rows.join(over, "repo_id", "left_anti").select("repo_id", "path").unionByName(cut.select("repo_id", "path")), over


def kind_of(path: Column) -> Column:
    base = P.basename(path)
    return (
        F.when(base == "AGENTS.md", "agents-md").when(base == "CLAUDE.md", "claude-md").when(path.endswith(".mdc"), "cursor-rule").when(path == ".github/copilot-instructions.md", "copilot-instructions")
        .when((base == ".windsurfrules") | path.contains(".windsurf/rules/"), "windsurf-rule").when(base == "SKILL.md", "skill").otherwise("other")
    )


def tools_of(kind: Column) -> Column:
    names = lambda *x: F.array(*map(F.lit, x))
    return (
        F.when(kind == "agents-md", names(*AGENTS_TOOLS)).when(kind.isin("claude-md", "skill"), names("claude-code")).when(kind == "cursor-rule", names("cursor"))
        .when(kind == "copilot-instructions", names("copilot")).when(kind == "windsurf-rule", names("windsurf")).otherwise(F.array().cast("array<string>"))
    )


def scope_of(path: Column, kind: Column) -> Column:
    depth = F.size(P.parts(path))
    rooted = F.when(kind.isin("agents-md", "claude-md"), 1).when(kind == "cursor-rule", 3).when(kind == "windsurf-rule", F.when(path.contains(".windsurf/rules/"), 3).otherwise(1))
    return F.when(rooted.isNull() | (depth == rooted), "repo-root").otherwise("subtree")


def surface_files(tree_rows: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    path = F.col("path")
    found = tree_rows.filter(P.like_globs(path, SURFACE_GLOBS))
    return found.filter(~P.like_globs(path, exclude_globs(exclude))) if exclude else found


def _within(max_bytes: int | None) -> Column:
    return F.lit(True) if max_bytes is None else F.col("length") <= max_bytes


def surfaces(tree_rows: DataFrame, exclude: list[str] | tuple[str, ...] = (), max_bytes: int | None = None, user_global: DataFrame | None = None) -> DataFrame:
    """Surfaces without meta: readable ones within the limit, and a user's own file (repo_id, raw) if given."""
    good = surface_files(tree_rows, exclude).filter(_within(max_bytes) & F.is_valid_utf8(F.col("content")))
    kind = kind_of(F.col("path"))
    own = good.select("repo_id", T.short_hash(F.col("path"), 10).alias("surface_id"), "path", kind.alias("kind"), scope_of(F.col("path"), kind).alias("scope"), tools_of(kind).alias("tools"), F.col("content").cast("string").alias("raw"))
    if user_global is not None:
        p = F.lit(USER_GLOBAL)
        own = own.unionByName(user_global.select("repo_id", T.short_hash(p, 10).alias("surface_id"), p.alias("path"), F.lit("claude-md").alias("kind"), F.lit("user-global").alias("scope"), F.array(F.lit("claude-code")).alias("tools"), "raw"))
    return own.withColumn("tokens_est", T.estimate_tokens(F.col("raw")))


def discovery_findings(tree_rows: DataFrame, over: DataFrame, exclude: list[str] | tuple[str, ...] = (), max_bytes: int | None = None, max_files: int | None = None) -> DataFrame:
    """Findings of surfaces that are too large or no UTF-8, and of indexes that were cut."""
    found = surface_files(tree_rows, exclude)
    kb = F.floor(F.col("length") / 1024 + 0.5).cast("string")
    large = found.filter(~_within(max_bytes)).select("repo_id", *finding("warn", "structure", F.concat("path", F.lit(" has "), kb, F.lit(f" KB (limit {(max_bytes or 0) // 1024} KB) and was left out. Split it.")), F.format_string("file size %d bytes", "length")))
    odd = found.filter(_within(max_bytes) & ~F.is_valid_utf8(F.col("content"))).select("repo_id", *finding("info", "structure", F.concat("path", F.lit(" is not UTF-8 and was left out.")), F.lit("invalid UTF-8")))
    cut = over.select("repo_id", *finding("info", "structure", F.lit(f"The file index was cut at {max_files} files; checks of references may be incomplete."), F.lit(f"more than {max_files} files")))
    return large.unionByName(odd).unionByName(cut)


def scripts(tree_rows: DataFrame) -> DataFrame:
    """repo_id, dir, script of readable manifests; one null script stands for each manifest itself."""
    manifests = tree_rows.filter((P.basename(F.col("path")) == "package.json") & F.col("content").isNotNull())
    read = manifests.select("repo_id", P.parent(F.col("path")).alias("dir"), F.from_json(F.col("content").cast("string"), "struct<scripts: map<string, string>, _bad: string>", {"columnNameOfCorruptRecord": "_bad"}).alias("m"))
    good = read.filter(F.col("m").isNotNull() & F.col("m._bad").isNull())
    return good.select("repo_id", "dir", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.map_keys("m.scripts"), F.array()))).alias("script"))


PARSED = f"struct<rules: array<struct<rule_id: string, text: string, section: array<string>, start_line: int, end_line: int, command: boolean, refs: array<string>>>, meta: {META}>"


def parse(surface_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surfaces with meta, and their rules; ord numbers a repository's rules by surface path and place."""
    fields = [("rule_id", pa.string()), ("text", pa.string()), ("section", pa.list_(pa.string())), ("start_line", pa.int32()), ("end_line", pa.int32()), ("command", pa.bool_()), ("refs", pa.list_(pa.string()))]
    meta = [("description", pa.string()), ("globs", pa.list_(pa.string())), ("always_apply", pa.bool_()), ("trigger", pa.string()), ("frontmatter_error", pa.string()), ("front_matter", pa.string())]
    kind = pa.struct([("rules", pa.list_(pa.struct(fields))), ("meta", pa.struct(meta))])

    @F.arrow_udf(PARSED)
    def read(path: pa.Array, kinds: pa.Array, ids: pa.Array, raw: pa.Array) -> pa.Array:
        rows = zip(path.to_pylist(), kinds.to_pylist(), ids.to_pylist(), raw.to_pylist(), strict=True)
        return pa.array([dict(zip(("rules", "meta"), M.parse_surface(*r), strict=True)) for r in rows], kind)

    # written, as surfaces, the ranges of the ranks, and the ranks ask for it, and each would parse all again
    parsed = settled(surface_rows.withColumn("parsed", read("path", "kind", "surface_id", "raw")), "parsed")
    known = parsed.withColumn("meta", F.col("parsed.meta")).drop("parsed")
    each = parsed.select("repo_id", "surface_id", "path", F.posexplode("parsed.rules").alias("pos", "r"))
    r = F.col("r")
    rules = with_ranks(each, ["repo_id"], [F.col("path"), F.col("pos")]).select(
        "repo_id", "surface_id", r["rule_id"].alias("rule_id"), (F.col("rank") + 1).cast("int").alias("ord"), r["text"].alias("text"), r["section"].alias("section"), r["start_line"].alias("start_line"),
        r["end_line"].alias("end_line"), F.when(r["command"], "command").otherwise(T.classify_rule(r["text"], F.size(r["refs"]))).alias("kind"), r["refs"].alias("refs"),
    )
    return known, rules


def parse_findings(known: DataFrame) -> DataFrame:
    """Findings of front matter that a tool can't read."""
    bad = known.filter(F.col("meta.frontmatter_error").isNotNull())
    head = F.array_join(F.slice(F.split("raw", "\n"), 1, 5), "\n")
    return bad.select("repo_id", *finding("warn", "structure", F.concat("path", F.lit(":1 has front matter that can't be read ("), "meta.frontmatter_error", F.lit("), so when it loads is unknown. Fix the YAML.")), head, surface_ids=F.array("surface_id")))


def ignored_rules(known: DataFrame, rules: DataFrame, marker: str = "rulegrain-ignore") -> DataFrame:
    """repo_id, rule_id of rules with the marker on one of their lines, or standing alone on the line above."""
    lines = known.join(rules.select("repo_id", "surface_id", "rule_id", "start_line", "end_line"), ["repo_id", "surface_id"]).withColumn("lines", F.split("raw", "\n"))
    above = F.get("lines", F.col("start_line") - 2)
    own = F.exists(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), lambda x: x.contains(marker))
    return lines.filter(F.coalesce(above.rlike(rf"^\s*<!--\s*{marker}\s*-->\s*$"), F.lit(False)) | own).select("repo_id", "rule_id").distinct()


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, errors="replace").stdout


def changes(repos: DataFrame, commits: int = 30) -> DataFrame:
    """repo_id, ord, sha, diff, merges, error: the last merges of each repository (plain commits if it has none); one row with error if there is no history."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for repo, root in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    merges = _git(root, "log", "--merges", "-n", str(commits), "--format=%H").split()
                    shas = merges or _git(root, "log", "-n", str(commits), "--format=%H").split()
                    for i, sha in enumerate(shas):
                        try:
                            rows.append((repo, i, sha, _git(root, "show", sha, "--format=", "--patch", "-m", "--first-parent", "--no-color"), bool(merges), None))
                        except subprocess.CalledProcessError:
                            continue
                    if not shas:
                        rows.append((repo, 0, None, None, False, "no commits"))
                except (OSError, subprocess.CalledProcessError):
                    rows.append((repo, 0, None, None, False, "no git history"))
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["repo_id", "ord", "sha", "diff", "merges", "error"])

    return repos.select("repo_id", "root").repartition("repo_id").mapInArrow(read, "repo_id string, ord int, sha string, diff string, merges boolean, error string")


def renames(repos: DataFrame) -> DataFrame:
    """repo_id, old, targets: every path that was renamed, and what it was renamed to, distinct and sorted."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for repo, root in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    lines = _git(root, "log", "--all", "--diff-filter=R", "--name-status", "--format=").split("\n")
                except (OSError, subprocess.CalledProcessError):
                    lines = []
                found = [x.split("\t") for x in lines if re.match(r"R[0-9]*\t[^\t]+\t[^\t]+$", x)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ([repo] * len(found), [f[1] for f in found], [f[2] for f in found])], names=["repo_id", "old", "new"])

    found = repos.select("repo_id", "root").repartition("repo_id").mapInArrow(read, "repo_id string, old string, new string")
    return found.groupBy("repo_id", "old").agg(F.array_sort(F.collect_set("new")).alias("targets"))


def clean_tree(root: str, own: tuple[str, ...] = ("rulegrain-fixes.md", ".rulegrain/")) -> str | None:
    """None if the tracked files of a root are unchanged (own outputs aside), else why it isn't clean."""
    try:
        dirty = [x for x in _git(root, "status", "--porcelain", "--untracked-files=no").split("\n") if x.strip() and not x[3:].startswith(own)]
    except (OSError, subprocess.CalledProcessError):
        return "no git repository: changes must be reviewable"
    return "tracked files have changes:\n" + "\n".join(dirty) if dirty else None
