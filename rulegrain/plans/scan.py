"""The whole scan: trees to surfaces to rules to findings to scores, for any number of repositories in one job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from ..functions.tokens import Vocabulary, with_estimates
from ..operators.budget import budget
from ..operators.contexts import contexts
from ..operators.contradiction import contradiction
from ..operators.scoring import apply_baseline, scores, with_fingerprints, without_ignored
from ..operators.similarity import duplication
from ..operators.staleness import directories, staleness
from ..operators.structure import structure
from ..sources import repos as R
from ..sources.config import Config
from ..sources.settled import settled


def analyze(surfaces: DataFrame, rules: DataFrame, files: DataFrame, scripts: DataFrame, truncated: DataFrame | None = None, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of all analyzers, and the contexts that they used.

    Each part is written once computed: the plans of all of them together would take longer to optimise than to run.
    """
    c = config or Config()
    loaded = settled(contexts(surfaces, files), "contexts")
    parts = [
        duplication(rules, surfaces, c.analysis.max_rules), contradiction(rules, surfaces, c.analysis.max_rules), staleness(rules, surfaces, files, scripts, truncated),
        budget(surfaces, rules, loaded, c.budgets.surface_warn_tokens, c.budgets.effective_context_warn_tokens, c.budgets.buried_rule_depth_ratio), structure(surfaces, rules),
    ]
    return reduce(DataFrame.unionByName, [settled(p, "findings") for p in parts]), loaded


def scan(
    repos: DataFrame, config: Config | None = None, user_global: DataFrame | None = None, baseline: DataFrame | None = None, vocabulary: Vocabulary | None = None,
    exact: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """surfaces, rules, files, contexts, findings, scores of repositories (repo_id, root); with a baseline also its counts.

    Findings that the baseline knows are left out before scoring; all_findings has them all, to write a new one.
    Token estimates are by a vocabulary, if there is one; exact (see exact_counter) adds tokens_exact to surfaces.
    """
    c = config or Config()
    d = c.discovery
    tree = settled(R.tree(repos, d.max_surface_bytes), "tree")
    files, over = (settled(x, "files") for x in R.file_index(tree, d.max_files))
    found = R.surfaces(tree, d.exclude, d.max_surface_bytes, user_global)
    surfaces, rules = (settled(x, "parsed") for x in R.parse(found))
    if vocabulary is not None:
        surfaces = settled(with_estimates(surfaces, vocabulary), "estimates")
    findings, loaded = analyze(surfaces, rules, files, R.scripts(tree), over, c)
    findings = findings.unionByName(R.discovery_findings(tree, over, d.exclude, d.max_surface_bytes, d.max_files)).unionByName(R.parse_findings(surfaces))
    findings = with_fingerprints(without_ignored(findings, R.ignored_rules(surfaces, rules)), surfaces)
    findings = settled(findings, "all_findings")
    out = {"surfaces": surfaces if exact is None else exact(surfaces), "rules": rules, "files": files, "contexts": loaded, "all_findings": findings}
    kept = findings
    if baseline is not None:
        kept, out["baseline"] = apply_baseline(findings, baseline)
    return out | {"findings": kept, "scores": scores(kept, repos), "index": files.unionByName(directories(files))}


def write_baseline(result: dict[str, DataFrame], path: str) -> None:
    """All findings' fingerprints, distinct and in order."""
    result["all_findings"].select("repo_id", "fingerprint").distinct().orderBy("repo_id", "fingerprint").write.mode("overwrite").json(path)
