"""Rules against changes: which rules may apply to which change, verdicts, their rollups, and how far judges agree."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .globs import matches
from .ranks import with_ranks

MAX_CHUNK_TOKENS = 4000
LEAST_LINES = 20
LEAST_KEYWORDS = 2
OUTPUT_TOKENS = 200
VERDICTS = ("followed", "violated", "not-applicable")
# Files whose changes say nothing about rules, and words that are no keywords.
SKIPPED = (
    r"(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|Cargo\.lock|composer\.lock|go\.sum)$|(^|/)(node_modules|vendor|dist|build|out|coverage|\.next|__generated__)/"
    r"|\.(min\.js|map|snap|lock)$|(^|/)(AGENTS\.md|CLAUDE\.md|SKILL\.md|\.cursorrules|\.windsurfrules)$|(^|/)\.cursor/rules/[^/]+\.mdc$|(^|/)\.windsurf/rules/[^/]+\.md$|^\.github/copilot-instructions\.md$"
)
STOPWORDS = (
    "the a an and or of to in on for with is are be it its this that these those do not don't never always must should use when before after into from "
    "them they your our you we as at by if any all one two here there was were"
).split()


def file_diffs(changes: DataFrame) -> DataFrame:
    """repo_id, ord, sha, pos, file, diff: each change (repo_id, ord, sha, diff) cut at its files, skipped files left out."""
    parts = F.filter(F.split("diff", r"(?m)^(?=diff --git )"), lambda p: p.startswith("diff --git "))
    each = changes.filter(F.col("diff").isNotNull()).select("repo_id", "ord", "sha", F.posexplode(parts).alias("pos", "diff"))
    file = F.regexp_extract("diff", r"(?m)^diff --git a/(.+?) b/(.+)$", 2)
    return each.withColumn("file", F.when(file == "", "unknown").otherwise(file)).filter(~F.col("file").rlike(SKIPPED)).select("repo_id", "ord", "sha", "pos", "file", "diff")


def tokens_of(text: str) -> int:
    return -(-len(text) // 4)


def shortened(diff: str, most: int, tokens: Callable[[str], int]) -> tuple[str, int]:
    """A diff cut to so many tokens, but not below LEAST_LINES lines; and its tokens."""
    cost = tokens(diff)
    if cost <= most:
        return diff, cost
    lines = diff.split("\n")
    keep = max(LEAST_LINES, len(lines) * most // cost)
    while True:
        text = "\n".join([*lines[:keep], f"... (cut at about {most} tokens)", ""])
        if (cost := tokens(text)) <= most or keep <= LEAST_LINES:
            return text, cost
        keep = keep * 8 // 10


CHUNKS = "repo_id string, chunk_id string, sha string, ord int, files array<string>, diff string, tokens_est int"


def pack_chunks(diffs: DataFrame, most: int = MAX_CHUNK_TOKENS, tokens: Callable[[str], int] = tokens_of) -> DataFrame:
    """Chunks of each change: its files in order, as many as fit. A change is one group, bounded by what a commit holds."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        out, files, parts, total = [], [], [], 0
        for r in [*rows, None]:
            text, cost = shortened(r["diff"], most, tokens) if r else ("", 0)
            if parts and (r is None or total + cost > most):
                diff = "".join(parts)
                out.append({"repo_id": rows[0]["repo_id"], "chunk_id": hashlib.sha1(diff.encode()).hexdigest()[:12], "sha": rows[0]["sha"], "ord": rows[0]["ord"], "files": files, "diff": diff, "tokens_est": total})
                files, parts, total = [], [], 0
            if r:
                files, parts, total = [*files, r["file"]], [*parts, text], total + cost
        kinds = [("repo_id", pa.string()), ("chunk_id", pa.string()), ("sha", pa.string()), ("ord", pa.int32()), ("files", pa.list_(pa.string())), ("diff", pa.string()), ("tokens_est", pa.int32())]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    return diffs.groupBy("repo_id", "sha").applyInArrow(run, CHUNKS)


def judgeable(rules: DataFrame, surfaces: DataFrame) -> DataFrame:
    return rules.filter("kind = 'imperative'").join(surfaces.filter("scope <> 'user-global'").select("repo_id", "surface_id", "path"), ["repo_id", "surface_id"])


def applicable(rules: DataFrame, chunks: DataFrame) -> DataFrame:
    """repo_id, rule_id, chunk_id of rules that may apply: by a path, by a pattern, or by two keywords. Three joins, none of them on all pairs."""
    files = chunks.select("repo_id", "chunk_id", F.explode("files").alias("file")).distinct()
    refs = rules.select("repo_id", "rule_id", F.explode("refs").alias("ref")).filter(~F.col("ref").startswith("npm run "))
    is_glob = F.col("ref").contains("*") | F.col("ref").contains("?")
    parts = F.split("file", "/")
    prefixes = files.select("repo_id", "chunk_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("ref"))
    by_path = refs.filter(~is_glob).withColumn("ref", F.regexp_replace("ref", "/$", "")).join(prefixes, ["repo_id", "ref"]).select("repo_id", "rule_id", "chunk_id")
    asked = refs.filter(is_glob).withColumnRenamed("ref", "glob")
    hit = matches(asked, files.withColumnRenamed("file", "path"), ["repo_id"]).join(files.withColumnRenamed("file", "path"), ["repo_id", "path"]).select("repo_id", "glob", "chunk_id").distinct()
    by_glob = asked.join(hit, ["repo_id", "glob"]).select("repo_id", "rule_id", "chunk_id")
    return by_path.unionByName(by_glob).unionByName(by_keywords(rules, chunks)).distinct()


def keywords(words: Column) -> Column:
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) >= 4) & ~w.isin(STOPWORDS))


def by_keywords(rules: DataFrame, chunks: DataFrame, least: int = LEAST_KEYWORDS) -> DataFrame:
    """repo_id, rule_id, chunk_id that share so many keywords.

    Words are made distinct in their rows, and words that no rule asks for never leave their tasks where
    the rules are few; a chunk that repeats counts once, as sets hold no more than a rule's keywords.
    """
    asked = rules.select("repo_id", "rule_id", keywords(T.normalize_words(F.col("text"))).alias("asked")).filter(F.size("asked") >= least)
    wanted = asked.select("repo_id", "rule_id", F.explode("asked").alias("word"))
    said = chunks.select("repo_id", "chunk_id", F.explode(F.array_distinct(T.normalize_words(F.col("diff")))).alias("word"))
    return wanted.join(said, ["repo_id", "word"]).groupBy("repo_id", "rule_id", "chunk_id").agg(F.collect_set("word").alias("shared")).filter(F.size("shared") >= least).select("repo_id", "rule_id", "chunk_id")


def dead_rules(rules: DataFrame, pairs: DataFrame) -> DataFrame:
    return rules.join(pairs, ["repo_id", "rule_id"], "left_anti")


def prompt(text: Column, sha: Column, files: Column, diff: Column) -> Column:
    return F.concat(
        F.lit("Decide whether a code change follows a project rule.\n\nRULE: "), text, F.lit("\n\nDIFF (commit "), F.substring(sha, 1, 10), F.lit(", files: "), F.array_join(files, ", "), F.lit("):\n"), diff,
        F.lit('\n\nAnswer with strict JSON only: {"verdict": "followed" | "violated" | "not-applicable", "evidence": "one short quote from the diff"}'),
    )


def parse_verdict(raw: Column) -> Column:
    """struct<verdict, evidence> of what a judge said, from its first { to its last }; null if that is no verdict."""
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    told = F.from_json(inner, "struct<verdict: string, evidence: string, _bad: string>", {"columnNameOfCorruptRecord": "_bad"})
    good = told.isNotNull() & told["_bad"].isNull() & told["verdict"].isin(*VERDICTS)
    return F.when(good, F.struct(told["verdict"].alias("verdict"), F.substring(F.coalesce(told["evidence"], F.lit("")), 1, 300).alias("evidence")))


def with_keys(pairs: DataFrame, model: str) -> DataFrame:
    """Pairs with the key that verdicts are kept under: rule text, chunk and model."""
    return pairs.withColumns({"rule_hash": T.short_hash(F.col("text")), "model": F.lit(model)})


def cost(pairs: DataFrame, cache: DataFrame, model: str, input_price: float, output_price: float) -> DataFrame:
    """repo_id, pairs, cached, input_tokens, output_tokens, usd of pairs (text, sha, files, diff, chunk_id); prices are per million tokens."""
    keyed = with_keys(pairs, model).join(cache.select("rule_hash", "chunk_id", "model", F.lit(True).alias("hit")).distinct(), ["rule_hash", "chunk_id", "model"], "left")
    asked = F.when(F.col("hit").isNull(), T.estimate_tokens(prompt(F.col("text"), F.col("sha"), F.col("files"), F.col("diff"))))
    told = keyed.groupBy("repo_id").agg(F.count("*").alias("pairs"), F.count("hit").alias("cached"), F.coalesce(F.sum(asked), F.lit(0)).alias("input_tokens"), (F.count_if(F.col("hit").isNull()) * OUTPUT_TOKENS).alias("output_tokens"))
    return told.withColumn("usd", (F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1_000_000)


def judge(pairs: DataFrame, cache: DataFrame, client: Callable[[str], str], model: str, concurrency: int = 4) -> DataFrame:
    """Pairs with verdict, evidence, from_cache, error. client answers a prompt; each distinct key is asked once, and errors aren't kept."""
    keyed = with_keys(pairs, model)
    keys = ["rule_hash", "chunk_id", "model"]
    known = cache.select(*keys, F.struct("verdict", "evidence").alias("kept")).dropDuplicates(keys)
    found = keyed.join(known, keys, "left")
    new = found.filter("kept is null").dropDuplicates(keys).withColumn("prompt", prompt(F.col("text"), F.col("sha"), F.col("files"), F.col("diff"))).select(*keys, "prompt").repartition(concurrency)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, errors = [], []
            for p in b.column("prompt").to_pylist():
                try:
                    said.append(client(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever a client raises belongs to its pair
                    said.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(said, pa.string()), pa.array(errors, pa.string())], names=[*keys, "said", "raised"])

    asked = new.mapInArrow(ask, "rule_hash string, chunk_id string, model string, said string, raised string").withColumn("told", parse_verdict(F.col("said")))
    done = found.join(asked, keys, "left")
    v = F.coalesce("kept", "told")
    error = F.when(v.isNull(), F.coalesce("raised", F.concat(F.lit("no verdict in: "), F.substring("said", 1, 80))))
    return done.withColumns({"verdict": v["verdict"], "evidence": F.coalesce(v["evidence"], F.lit("")), "from_cache": F.col("kept").isNotNull(), "error": error}).drop("kept", "said", "raised", "told")


def rule_reports(judged: DataFrame) -> DataFrame:
    """repo_id, rule_id, applicable, followed, violated, errors, evidences: verdicts by rule, most violated first when ordered by violated and applicable."""
    ok = F.col("error").isNull()
    is_ = lambda v: ok & (F.col("verdict") == v)
    quote = F.struct("chunk_id", F.substring("sha", 1, 10).alias("sha"), "evidence")
    return judged.groupBy("repo_id", "rule_id").agg(
        F.count_if(ok & (F.col("verdict") != "not-applicable")).alias("applicable"), F.count_if(is_("followed")).alias("followed"), F.count_if(is_("violated")).alias("violated"),
        F.count_if(~ok).alias("errors"), F.array_sort(F.collect_list(F.when(is_("violated"), quote))).alias("evidences"),
    )


def calibration_sample(pairs: DataFrame, ratio: float) -> DataFrame:
    """Every k-th pair of each repository by rule and chunk."""
    step = max(1, int(1 / max(ratio, 0.0001)))
    turn = F.collate(F.concat_ws("|", "rule_id", "chunk_id"), "UNICODE")
    return with_ranks(pairs, ["repo_id"], [turn], "_rn", "_count").filter(F.col("_rn") % step == 0).drop("_rn", "_count")


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """repo_id, compared, agreed, agreement of pairs on which both judges gave a verdict."""
    key = ["repo_id", "rule_id", "chunk_id"]
    told = lambda d, n: d.filter("verdict is not null").select(*key, F.col("verdict").alias(n)).dropDuplicates(key)
    both = told(first, "a").join(told(second, "b"), key)
    agreed = F.count_if(F.col("a") == F.col("b"))
    return both.groupBy("repo_id").agg(F.count("*").alias("compared"), agreed.alias("agreed"), (agreed / F.count("*")).alias("agreement"))


def new_verdicts(judged: DataFrame) -> DataFrame:
    """Rows to append to the cache."""
    return judged.filter("error is null and not from_cache").select("rule_hash", "chunk_id", "model", "verdict", "evidence").dropDuplicates(["rule_hash", "chunk_id", "model"])


def status(no_history: bool, n_rules: int, n_pairs: int, usd: float, cap: float, agreed: bool = False) -> str:
    if no_history:
        return "no-git"
    if not n_rules:
        return "no-rules"
    if not n_pairs:
        return "nothing-to-judge"
    return "over-cap" if usd > cap and not agreed else "ok"


