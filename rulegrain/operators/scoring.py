"""Health scores, baselines, and rollups of labelled findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.settled import settled

# Penalties, their decay, which category counts where, and the weights of the total.
PENALTY = {"error": 25, "warn": 10, "info": 4}
DECAY = 0.8
SUBSCORE = {
    "stale-reference": "freshness", "duplication": "uniqueness", "drift": "consistency", "contradiction": "consistency",
    "budget": "budget", "structure": "structure", "load-semantics": "structure", "dead-rule": "structure",
}
WEIGHT = {"freshness": 0.25, "uniqueness": 0.2, "consistency": 0.25, "budget": 0.15, "structure": 0.15}
#: Penalties beyond this rank add less than a thousandth of a point in all.
LAST_RANK = 60


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def subscores(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """repo_id, subscore, value: 100 less the penalties, worst first, each counting DECAY of the one before.

    Equal penalties are counted first, so a repository's rows never meet in one window: with n equal ones from
    rank r on, their sum is a geometric series.
    """
    rows = findings.select("repo_id", _lookup(SUBSCORE, F.col("category")).alias("subscore"), _lookup(PENALTY, F.col("severity")).alias("penalty"))
    counted = rows.groupBy("repo_id", "subscore", "penalty").agg(F.count("*").alias("n"))
    before = Window.partitionBy("repo_id", "subscore").orderBy(F.desc("penalty")).rowsBetween(Window.unboundedPreceding, -1)
    series = F.col("penalty") * F.pow(F.lit(DECAY), F.coalesce(F.sum("n").over(before), F.lit(0))) * (1 - F.pow(F.lit(DECAY), F.col("n"))) / (1 - DECAY)
    summed = counted.withColumn("p", series).groupBy("repo_id", "subscore").agg(F.sum("p").alias("p"))
    every = repos.select("repo_id").distinct().select("repo_id", F.explode(F.array(*map(F.lit, WEIGHT))).alias("subscore"))
    value = F.greatest(F.lit(0), half_up(F.round(100 - F.coalesce("p", F.lit(0.0)), 9)))
    return every.join(summed, ["repo_id", "subscore"], "left").select("repo_id", "subscore", value.cast("int").alias("value"))


def scores(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """repo_id, total and the five subscores; repositories without findings have 100."""
    values = subscores(findings, repos)
    wide = [F.max(F.when(F.col("subscore") == s, F.col("value"))).alias(s) for s in WEIGHT]
    total = half_up(F.round(F.sum(F.col("value") * _lookup(WEIGHT, F.col("subscore"))), 9)).cast("int").alias("total")
    return values.groupBy("repo_id").agg(total, *wide)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in PENALTY])


def gate(findings: DataFrame, score_rows: DataFrame, min_score: int = 0, fail_on_errors: bool = True) -> DataFrame:
    """repo_id, errors, total, passed: no errors (if they count) and the least score (0: any)."""
    told = score_rows.select("repo_id", "total").join(severity_counts(findings).select("repo_id", F.col("error").alias("errors")), "repo_id", "left")
    errors = F.coalesce("errors", F.lit(0))
    return told.select("repo_id", errors.alias("errors"), "total", ((errors == 0) | F.lit(not fail_on_errors)).__and__(F.col("total") >= min_score).alias("passed"))


def _numbered(findings: DataFrame) -> DataFrame:
    """Findings with a row number, written, so that both sides of a join see the same numbers."""
    return settled(findings.withColumn("row", F.monotonically_increasing_id()), "numbered")


def with_fingerprints(findings: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Findings with their fingerprint: surface ids give way to paths, digits in messages don't count."""
    marked = _numbered(findings)
    ids = marked.select("row", "repo_id", F.explode_outer("surface_ids").alias("surface_id"))
    named = ids.join(surfaces.select("repo_id", "surface_id", "path"), ["repo_id", "surface_id"], "left").groupBy("row").agg(F.collect_list(F.coalesce("path", "surface_id")).alias("paths"))
    told = marked.join(named, "row")
    return told.withColumn("fingerprint", T.fingerprint(F.col("category"), F.col("rule_ids"), F.col("paths"), F.col("message"))).drop("row", "paths")


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (with fingerprint) that the baseline (repo_id, fingerprint) doesn't have; and repo_id, suppressed, stale."""
    entries = baseline.select("repo_id", "fingerprint").distinct()
    kept = findings.join(entries, ["repo_id", "fingerprint"], "left_anti")
    gone = findings.join(entries, ["repo_id", "fingerprint"], "left_semi").groupBy("repo_id").agg(F.count("*").alias("suppressed"))
    stale = entries.join(findings, ["repo_id", "fingerprint"], "left_anti").groupBy("repo_id").agg(F.count("*").alias("stale"))
    counts = entries.select("repo_id").distinct().join(gone, "repo_id", "left").join(stale, "repo_id", "left").na.fill(0, ["suppressed", "stale"])
    return kept, counts


def without_ignored(findings: DataFrame, ignored: DataFrame) -> DataFrame:
    """Findings that touch none of the ignored rules (repo_id, rule_id)."""
    marked = _numbered(findings)
    hit = marked.select("row", "repo_id", F.explode("rule_ids").alias("rule_id")).join(ignored, ["repo_id", "rule_id"], "left_semi").select("row").distinct()
    return marked.join(hit, "row", "left_anti").drop("row")


def precision(keys: DataFrame, labels: DataFrame, by: str = "category") -> DataFrame:
    """by (null: all), tp, fp, unlabeled, precision of keys (key, by) under labels (key, label); precision is null without labels."""
    joined = keys.join(labels.select("key", "label"), "key", "left")
    tp, fp = F.count_if(F.col("label") == "tp"), F.count_if(F.col("label") == "fp")
    return joined.rollup(by).agg(tp.alias("tp"), fp.alias("fp"), F.count_if(F.col("label").isNull()).alias("unlabeled"), F.try_divide(tp, tp + fp).alias("precision"))


def recall(seeded: DataFrame, by: str = "defect") -> DataFrame:
    """by (null: all), seeded, caught, recall of seeded (by, caught boolean)."""
    caught = F.count_if("caught")
    return seeded.rollup(by).agg(F.count("*").alias("seeded"), caught.alias("caught"), F.try_divide(caught, F.count("*")).alias("recall"))


def snapshot_drift(now: DataFrame, then: DataFrame) -> DataFrame:
    """Rows of either snapshot that the other lacks, with side."""
    return now.exceptAll(then).withColumn("side", F.lit("new")).unionByName(then.exceptAll(now).withColumn("side", F.lit("gone")))


def finding_key(repo: Column, category: Column, message: Column) -> Column:
    return T.short_hash(F.concat_ws("|", repo, category, message))


def corpus_problems(entries: DataFrame) -> DataFrame:
    """name, problem of corpus entries (name, repo, sha): names must be unique, repo a slug, sha of 40 hex digits."""
    counted = entries.withColumn("times", F.count("*").over(Window.partitionBy("name")))
    checks = F.array(
        F.when(F.col("times") > 1, "name is used twice"), F.when(~F.col("repo").rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), "repo is no owner/name slug"), F.when(~F.col("sha").rlike("^[0-9a-f]{40}$"), "sha has not 40 hex digits")
    )
    return counted.select("name", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem")).distinct()
