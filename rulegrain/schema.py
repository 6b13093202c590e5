"""Columns of the relations that operators take and give. repo_id keys every one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closed sets of the data model.
TOOLS = ("claude-code", "cursor", "copilot", "codex", "windsurf", "generic-agents-md")
KINDS = ("agents-md", "claude-md", "copilot-instructions", "cursor-rule", "windsurf-rule", "skill", "other")
SEVERITIES = ("error", "warn", "info")
CATEGORIES = ("stale-reference", "duplication", "drift", "contradiction", "budget", "structure", "load-semantics", "dead-rule")

META = "struct<description: string, globs: array<string>, always_apply: boolean, trigger: string, frontmatter_error: string, front_matter: string>"
SURFACES = f"repo_id string, surface_id string, path string, kind string, scope string, tools array<string>, raw string, tokens_est int, meta {META}"
RULES = "repo_id string, surface_id string, rule_id string, ord int, text string, section array<string>, start_line int, end_line int, kind string, refs array<string>"
FIX = "struct<kind: string, description: string, ref: string>"
FINDINGS = f"repo_id string, rule_ids array<string>, surface_ids array<string>, severity string, category string, message string, evidence string, fix {FIX}"
FILES = "repo_id string, path string"
SCRIPTS = "repo_id string, dir string, script string"

#: Severities by rank, for order.
RANK = {s: i for i, s in enumerate(SEVERITIES)}


def finding(severity: Column | str, category: Column | str, message: Column, evidence: Column, rule_ids: Column | None = None, surface_ids: Column | None = None, fix: tuple | None = None) -> list[Column]:
    """The finding's columns, for a select beside repo_id. fix: kind, description and reference."""
    none = F.array().cast("array<string>")
    value = lambda x: F.lit(x) if isinstance(x, str) else x
    kind, description, ref = [*(fix or ()), None, None, None][:3]
    told = F.struct(F.lit(kind).alias("kind"), value(description).alias("description") if fix else F.lit(None).cast("string").alias("description"), (ref if ref is not None else F.lit(None).cast("string")).alias("ref"))
    return [
        (none if rule_ids is None else rule_ids).alias("rule_ids"), (none if surface_ids is None else surface_ids).alias("surface_ids"), value(severity).alias("severity"),
        value(category).alias("category"), message.alias("message"), evidence.alias("evidence"), (told if fix else F.lit(None)).cast(FIX).alias("fix"),
    ]


def place(path: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", path, start, end)


def in_order(findings: DataFrame) -> DataFrame:
    """By severity, category and message, as Unicode collates them."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("severity"))
    return findings.orderBy("repo_id", rank, F.collate("category", "UNICODE"), F.collate("message", "UNICODE"))
