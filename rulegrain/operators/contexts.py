"""Which surfaces each tool loads in each directory, in what order, always or on a condition.

One relation of entries for all tools: surfaces are joined to the directories that lie at or below theirs,
each tool's load order is a sort key, and conditions are a CASE over the surfaces' front matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..schema import TOOLS
from ..sources.settled import settled
from .globs import matches

# What each tool loads, by kind of surface and branch of its order.
LOADS = (
    ("claude-code", "claude-md", 1), ("claude-code", "agents-md", 2), ("codex", "agents-md", 1), ("generic-agents-md", "agents-md", 1),
    ("copilot", "copilot-instructions", 0), ("copilot", "agents-md", 1), ("cursor", "agents-md", 0), ("cursor", "cursor-rule", 1), ("windsurf", "windsurf-rule", 0),
)

# Where each tool's behaviour is documented, when it was checked, and what is assumed.
BEHAVIOR = (
    ("claude-code", "https://code.claude.com/docs/en/memory", "2026-07-08", ("order of AGENTS.md and CLAUDE.md at one level",)),
    ("cursor", "https://docs.cursor.com/context/rules", "2026-07-08", ("rules without alwaysApply and globs load on request only", ".cursorrules is no longer loaded", "nested globs match from the root or from the rule's directory")),
    ("copilot", "https://docs.github.com/en/copilot/customizing-copilot/adding-repository-custom-instructions-for-github-copilot", "2026-07-08", ("nested AGENTS.md files hold for what is below them",)),
    ("codex", "https://developers.openai.com/codex", "2026-07-08", ("AGENTS.md files are merged from the root down",)),
    ("windsurf", "https://docs.windsurf.com/windsurf/cascade/memories", "2026-07-08", ("triggers of rule files", "rules that aren't always on load on demand only", "nested globs match from the root or from the rule's directory")),
    ("generic-agents-md", "https://agents.md", "2026-07-08", ("the nearest AGENTS.md wins, those above still hold",)),
)


def attached(path: Column, kind: Column) -> Column:
    """The directory that a surface belongs to: above its rules folder, else its own."""
    nested = (kind == "cursor-rule") | ((kind == "windsurf-rule") & path.contains(".windsurf/rules/"))
    before = F.regexp_replace(F.regexp_extract(path, r"^(.*?)\.(?:cursor|windsurf)/rules/", 1), "/$", "")
    return F.when(~nested, P.parent(path)).when(before == "", ".").otherwise(before)


def described(scope: Column, at: Column, directory: Column) -> Column:
    return (
        F.when(scope == "user-global", "user-global (teammates don't see it)").when(at == ".", "repo root")
        .when(at == directory, F.concat(F.lit("this directory ("), at, F.lit(")"))).otherwise(F.concat(F.lit("ancestor directory "), at))
    )


def active_globs(asked: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, surface_id, directory for which a glob of the surface matches a file below the directory.

    asked: repo_id, surface_id, at, directory, globs. Matched from the root, or from the surface's directory.
    """
    one = asked.select("repo_id", "surface_id", "at", "directory", F.explode("globs").alias("glob"))
    places = one.select("repo_id", "at").distinct()
    # paths as seen from each directory that has surfaces, and from the root
    above = files.select("repo_id", "path", F.explode(F.array_union(F.array(F.lit(".")), P.proper_ancestors(F.col("path")))).alias("at"))
    seen = above.join(places.unionByName(places.withColumn("at", F.lit("."))).distinct(), ["repo_id", "at"]).withColumn("inner", F.when(F.col("at") == ".", F.col("path")).otherwise(F.substring(F.col("path"), F.length("at") + 2, F.length("path"))))
    asks = one.select("repo_id", "at", "glob").unionByName(one.select("repo_id", F.lit(".").alias("at"), "glob")).distinct()
    found = matches(asks, seen.select("repo_id", "at", F.col("inner").alias("path")), ["repo_id", "at"])
    full = found.select("repo_id", "at", "glob", P.join(F.col("at"), F.col("path")).alias("file"))
    hit = full.select("repo_id", "at", "glob", F.explode(F.array_union(F.array(F.lit(".")), P.proper_ancestors(F.col("file")))).alias("directory")).distinct()
    by_own = one.join(hit, ["repo_id", "at", "glob", "directory"], "left_semi")
    by_root = one.join(hit.filter("at = '.'").drop("at"), ["repo_id", "glob", "directory"], "left_semi")
    return by_own.select("repo_id", "surface_id", "directory").unionByName(by_root.select("repo_id", "surface_id", "directory")).distinct()


def entries(surfaces: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, tool, directory, ord, surface_id, path, tokens_est, reason, conditional: what each tool loads at the root and wherever a subtree has surfaces."""
    spark = surfaces.sparkSession
    loads = F.broadcast(spark.createDataFrame(LOADS, "tool string, kind string, branch int"))
    here = surfaces.withColumn("at", attached(F.col("path"), F.col("kind")))
    dirs = here.select("repo_id", F.lit(".").alias("directory")).unionByName(here.filter("scope = 'subtree'").select("repo_id", F.col("at").alias("directory"))).distinct()
    above = dirs.select("repo_id", "directory", F.explode(P.chain(F.col("directory"))).alias("at"))
    own = here.filter("scope <> 'user-global'").join(loads, "kind")
    # the one instruction file of a repository holds everywhere, and only the first counts
    first = Window.partitionBy("repo_id", "tool").orderBy("path")
    wide = own.filter("kind = 'copilot-instructions'").withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn").join(dirs, "repo_id")
    chained = own.filter("kind <> 'copilot-instructions'").join(above, ["repo_id", "at"])
    glob_user = here.filter("scope = 'user-global' and kind = 'claude-md'").withColumns({"tool": F.lit("claude-code"), "branch": F.lit(0)}).join(dirs, "repo_id")
    all_ = wide.unionByName(chained, allowMissingColumns=True).unionByName(glob_user, allowMissingColumns=True)

    globs, kind = F.col("meta.globs"), F.col("kind")
    legacy = F.col("path").endswith(".windsurfrules")
    wants = F.coalesce(F.size(globs), F.lit(0)) > 0
    by_glob = wants & ((kind == "cursor-rule") & ~F.coalesce(F.col("meta.always_apply"), F.lit(False)) | (kind == "windsurf-rule") & (F.col("meta.trigger") == "glob"))
    # what is loaded is asked for several times; which globs are active is found once
    active = settled(active_globs(all_.filter(by_glob).select("repo_id", "surface_id", "at", "directory", globs.alias("globs")), files), "active").withColumn("active", F.lit(True))
    told = all_.join(active, ["repo_id", "surface_id", "directory"], "left")
    shown = F.array_join(F.transform(globs, lambda g: F.concat(F.lit("`"), g, F.lit("`"))), ", ")
    where = described(F.col("scope"), F.col("at"), F.col("directory"))
    rule = kind.isin("cursor-rule", "windsurf-rule") & ~legacy
    broken = F.col("meta.frontmatter_error").isNotNull()
    always = F.when(kind == "cursor-rule", F.coalesce(F.col("meta.always_apply"), F.lit(False))).otherwise(F.coalesce(F.col("meta.trigger") == "always_on", F.lit(False)))
    reason = (
        F.when((F.col("scope") == "user-global"), "user-global CLAUDE.md, loaded for every repository; teammates don't see it")
        .when(kind == "claude-md", F.concat(F.lit("CLAUDE.md at "), where))
        .when(kind == "copilot-instructions", "copilot-instructions.md for the whole repository")
        .when(kind == "agents-md", F.concat(F.lit("AGENTS.md at "), where))
        .when(legacy, ".windsurfrules, always on (deprecated)")
        .when(broken, "front matter can't be read: when it loads is unknown")
        .when(always, F.when(kind == "cursor-rule", "alwaysApply: true").otherwise("trigger: always_on"))
        .when(by_glob & F.col("active"), F.concat(F.lit("loads for files matching "), shown))
        .when(by_glob, F.concat(F.lit("globs "), shown, F.lit(" match nothing under "), "directory"))
        .when(kind == "cursor-rule", "neither alwaysApply nor globs: on request only (assumed)")
        .otherwise(F.concat(F.lit("trigger: "), F.coalesce("meta.trigger", F.lit("unset")), F.lit(": on demand only (assumed)")))
    )
    depth = F.when(rule | legacy, 0).otherwise(F.size(P.parts(F.col("path"))))
    turn = Window.partitionBy("repo_id", "tool", "directory").orderBy("branch", depth, "path")
    return told.select(
        "repo_id", "tool", "directory", F.row_number().over(turn).alias("ord"), "surface_id", "path", "tokens_est", reason.alias("reason"), (rule & (broken | ~always)).alias("conditional")
    )


def contexts(surfaces: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, tool, directory, entries (in order), tokens_always, tokens_conditional: every tool at the root, and where its list differs from there."""
    loaded = entries(surfaces, files)
    one = F.struct("ord", "surface_id", "path", "tokens_est", "reason", "conditional")
    grouped = loaded.groupBy("repo_id", "tool", "directory").agg(
        F.array_sort(F.collect_list(one)).alias("entries"),
        F.sum(F.when(F.col("conditional"), 0).otherwise(F.col("tokens_est"))).alias("tokens_always"),
        F.sum(F.when(F.col("conditional"), F.col("tokens_est")).otherwise(0)).alias("tokens_conditional"),
    )
    tools = F.explode(F.array(*map(F.lit, TOOLS))).alias("tool")
    roots = surfaces.select("repo_id").distinct().select("repo_id", tools, F.lit(".").alias("directory"))
    places = roots.unionByName(grouped.filter("directory <> '.'").select("repo_id", "tool", "directory"))
    # a directory in which a tool loads nothing differs from a root in which it loads something; chains keep the root's, so there is none
    full = places.join(grouped, ["repo_id", "tool", "directory"], "left").withColumn("list", F.transform(F.coalesce("entries", F.array()), lambda e: e["path"]))
    root = full.filter("directory = '.'").select("repo_id", "tool", F.col("list").alias("root_list"))
    kept = full.join(root, ["repo_id", "tool"]).filter((F.col("directory") == ".") | (F.col("list") != F.col("root_list")))
    return kept.select("repo_id", "tool", "directory", "entries", F.coalesce("tokens_always", F.lit(0)).alias("tokens_always"), F.coalesce("tokens_conditional", F.lit(0)).alias("tokens_conditional"))


def behavior(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BEHAVIOR, "tool string, docs_url string, last_verified string, assumptions array<string>")


def provenance(context_rows: DataFrame) -> DataFrame:
    """The behaviour rows of tools that load a surface anywhere, by repository."""
    used = context_rows.filter(F.size(F.coalesce("entries", F.array())) > 0).select("repo_id", "tool").distinct()
    return used.join(F.broadcast(behavior(context_rows.sparkSession)), "tool")


