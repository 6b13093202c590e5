"""Rules that say the opposite about the same thing: joined on pairs of content words, two of which must be shared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import finding, place
from ..sources.settled import settled
from .similarity import DUPLICATE, capped, members_of, with_shingles

LEAST_SHARED = 2


def directives(rules: DataFrame) -> DataFrame:
    """repo_id, rule_id, ord, pos, sentence, polarity, core: sentences with a polarity and content, without scoped exceptions."""
    split = rules.select("repo_id", "rule_id", "surface_id", "ord", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    s = F.col("sentence")
    told = split.withColumn("polarity", T.polarity(s)).filter(F.col("polarity") != "none").filter(~T.is_scoped_exception(s))
    return told.withColumn("core", T.directive_core(s)).filter(F.size("core") > 0)


def opposed(said: DataFrame) -> DataFrame:
    """repo_id, a, b, shared: pairs of rules (the first by ord is a) that share LEAST_SHARED pairs of words or more in sentences of opposite polarity.

    said: directives(). Rules that say the same are one class: classes are joined, and rows are made of their members
    at the end. A rule_id has one ord.
    """
    words = said.select("repo_id", "rule_id", "ord", "polarity", F.explode("core").alias("pair"))
    marks = F.sort_array(F.collect_list(F.struct("polarity", "pair")))
    told = settled(words.groupBy("repo_id", "rule_id", "ord").agg(marks.alias("marks")).withColumn("cls", F.concat_ws(" ", F.xxhash64("marks"), F.xxhash64(F.reverse("marks")))), "said")
    one = told.groupBy("repo_id", "cls").agg(F.any_value("marks").alias("marks")).select("repo_id", "cls", F.inline("marks"))
    a, b = one.alias("a"), one.alias("b")
    on = (F.col("a.repo_id") == F.col("b.repo_id")) & (F.col("a.pair") == F.col("b.pair")) & (F.col("a.polarity") != F.col("b.polarity")) & (F.col("a.cls") <= F.col("b.cls"))
    met = a.join(b, on).groupBy(F.col("a.repo_id").alias("repo_id"), F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).agg(F.count("*").alias("shared"))
    # two rules of one class: each meeting of its own marks was counted from both sides, as two rules' are
    pairs = settled(met.filter(F.col("shared") >= LEAST_SHARED), "opposed")
    each = members_of(pairs, told.select("repo_id", "cls", "ord", F.col("rule_id").alias("id"), F.lit(None).cast("string").alias("grp")))
    first = F.col("_a.ord") < F.col("_b.ord")
    return each.select("repo_id", F.when(first, F.col("_a.id")).otherwise(F.col("_b.id")).alias("a"), F.when(first, F.col("_b.id")).otherwise(F.col("_a.id")).alias("b"), "shared")


def contradiction(rules: DataFrame, surfaces: DataFrame, max_rules: int | None = None) -> DataFrame:
    """Findings: each pair of rules once, by its first pair of sentences. Pairs of near duplicates don't count."""
    few, _ = capped(rules, max_rules)
    said = directives(few)
    words = said.select("repo_id", "rule_id", "ord", "pos", "polarity", F.explode("core").alias("pair"))
    a, b = words.alias("a"), words.alias("b")
    on = (F.col("a.repo_id") == F.col("b.repo_id")) & (F.col("a.pair") == F.col("b.pair")) & (F.col("a.polarity") != F.col("b.polarity")) & (F.col("a.ord") < F.col("b.ord"))
    key = ["repo_id", "a", "b", "pa", "pb"]
    shared = (
        a.join(b, on).select(F.col("a.repo_id").alias("repo_id"), F.col("a.rule_id").alias("a"), F.col("b.rule_id").alias("b"), F.col("a.pos").alias("pa"), F.col("b.pos").alias("pb"))
        .groupBy(key).agg(F.count("*").alias("shared")).filter(F.col("shared") >= LEAST_SHARED)
        .filter("a <> b")
    )
    first = Window.partitionBy("repo_id", "a", "b").orderBy("pa", "pb")
    hits = shared.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn", "shared")
    at = surfaces.select("repo_id", "surface_id", "path")
    sets = with_shingles(few.join(at, ["repo_id", "surface_id"])).select("repo_id", "rule_id", "surface_id", "tokens", place(F.col("path"), F.col("start_line"), F.col("end_line")).alias("at"))
    side = lambda s: sets.select("repo_id", F.col("rule_id").alias(s), F.struct("surface_id", "tokens", "at").alias(f"r{s}"))
    line = lambda s: said.select("repo_id", F.col("rule_id").alias(s), F.col("pos").alias(f"p{s}"), F.col("sentence").alias(f"s{s}"))
    both = hits.join(side("a"), ["repo_id", "a"]).join(side("b"), ["repo_id", "b"]).join(line("a"), ["repo_id", "a", "pa"]).join(line("b"), ["repo_id", "b", "pb"])
    apart = both.filter(T.jaccard(F.col("ra.tokens"), F.col("rb.tokens")) < DUPLICATE)
    return apart.select(
        "repo_id",
        *finding(
            "warn", "contradiction", F.concat(F.lit("Opposite instructions about the same thing: "), "ra.at", F.lit(" and "), "rb.at", F.lit(". Pick one. (Polarity is read in English only.)")),
            F.concat(F.lit('A: "'), "sa", F.lit('"\nB: "'), "sb", F.lit('"')), F.array("a", "b"), F.array_distinct(F.array("ra.surface_id", "rb.surface_id")),
            ("rewrite", "Keep the right instruction and say where it holds."),
        ),
    )
