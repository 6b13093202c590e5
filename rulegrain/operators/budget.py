"""Size budgets: surfaces and contexts that are too long, and critical rules that stand too deep in long surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import finding

SURFACE_TOKENS, CONTEXT_TOKENS, BURIED_DEPTH = 1500, 4000, 0.7
PREVIEWED = 3


def long_surfaces(surfaces: DataFrame, most: int = SURFACE_TOKENS) -> DataFrame:
    return surfaces.filter(F.col("tokens_est") > most)


def buried_rules(rules: DataFrame, surfaces: DataFrame, most: int = SURFACE_TOKENS, depth: float = BURIED_DEPTH) -> DataFrame:
    """repo_id, surface_id, path, lines, buried (ord, rule_id, start_line, text): critical imperative rules beyond a share of a long surface's lines."""
    lines = F.size(F.split("raw", "\n", -1))
    long = long_surfaces(surfaces, most).select("repo_id", "surface_id", "path", lines.alias("lines"))
    deep = rules.join(long, ["repo_id", "surface_id"]).filter((F.col("start_line") / F.col("lines") > depth) & (F.col("kind") == "imperative") & T.is_critical(F.col("text")))
    return deep.groupBy("repo_id", "surface_id", "path", "lines").agg(F.array_sort(F.collect_list(F.struct("ord", "rule_id", "start_line", "text"))).alias("buried"))


def budget(surfaces: DataFrame, rules: DataFrame, contexts: DataFrame, surface_tokens: int = SURFACE_TOKENS, context_tokens: int = CONTEXT_TOKENS, depth: float = BURIED_DEPTH) -> DataFrame:
    about = F.format_string("about %d tokens", "tokens_est")
    tools = F.when(F.size("tools") > 0, F.array_join("tools", ", ")).otherwise("no tool")
    large = long_surfaces(surfaces, surface_tokens).select(
        "repo_id",
        *finding(
            "warn", "budget", F.concat("path", F.lit(" has "), about, F.lit(f" (budget: {surface_tokens}), loaded with each request of "), tools, F.lit(". Trim or split it.")), about,
            surface_ids=F.array("surface_id"), fix=("split-file", "Keep what always matters; move reference matter to files that are read on demand."),
        ),
    )
    last = F.element_at("buried", -1)["start_line"]
    preview = F.array_join(F.transform(F.slice("buried", 1, PREVIEWED), lambda r: F.concat("path", F.lit(":"), r["start_line"].cast("string"), F.lit(' "'), F.substring(r["text"], 1, 90), F.lit('"'))), "\n")
    more = F.when(F.size("buried") > PREVIEWED, F.format_string("\n... and %d more", F.size("buried") - PREVIEWED)).otherwise("")
    deep = buried_rules(rules, surfaces, surface_tokens, depth).select(
        "repo_id",
        *finding(
            "warn", "budget",
            F.concat(F.size("buried").cast("string"), F.lit(f" critical rule(s) beyond {round(depth * 100)}% of "), "path", F.lit(" (deepest at line "), last.cast("string"), F.lit(" = "), T.percent(last / F.col("lines")), F.lit("%). Move them to the front.")),
            F.concat(preview, more), F.transform("buried", lambda r: r["rule_id"]), F.array("surface_id"), ("move-to-front", "Put these rules into a section at the top."),
        ),
    )
    always = F.filter("entries", lambda e: ~e["conditional"])
    listed = F.array_join(F.transform(always, lambda e: F.concat(e["path"], F.lit(" ("), e["tokens_est"].cast("string"), F.lit(")"))), ", ")
    heavy = contexts.filter(F.col("tokens_always") > context_tokens).withColumn("listed", listed).select(
        "repo_id",
        *finding(
            "warn", "budget", F.concat("tool", F.lit(" in "), "directory", F.lit(" always loads about "), F.col("tokens_always").cast("string"), F.lit(f" tokens (budget: {context_tokens}). Trim: "), "listed"), F.col("listed"),
            surface_ids=F.transform("entries", lambda e: e["surface_id"]),
        ),
    )
    return large.unionByName(deep).unionByName(heavy)
