"""Queries of the operators over the driver's tables, each with the same in DuckDB SQL where SQL can say it.

The tables hold no context files, so their rows stand in: documents and their lines for surfaces and rules,
parts for short rules with a polarity, page URLs for paths, events for findings, labels for verdicts.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import paths as P
from ..functions import text as T
from ..functions.diffs import diff_words
from ..functions.tokens import load_vocabulary, token_counts
from ..operators import budget as B
from ..operators import compliance as C
from ..operators import contexts as X
from ..operators import contradiction as D
from ..operators import fixes as W
from ..operators import scoring as S
from ..operators import seeding as SD
from ..operators import similarity as SIM
from ..operators import staleness as ST
from ..operators import structure as U
from ..schema import KINDS, META
from ..sources import repos as R
from ..sources.settled import settled
from . import recall as RC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# ---- SQL pieces

def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


WORDS = r"list_filter(list_transform(string_split(regexp_replace(replace(lower({0}), '`', ' '), '[^\p{{L}}\p{{N}}/*.@-]+', ' ', 'g'), ' '), lambda w: regexp_replace(w, '^[.-]+|[.-]+$', '', 'g')), lambda w: w <> '')"
GRAMS = "CASE WHEN len({0}) = 0 THEN []::VARCHAR[] WHEN len({0}) <= 5 THEN [array_to_string({0}, ' ')] ELSE list_distinct(list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i + 4], ' '))) END"
DOC_GRAMS = f"words AS (SELECT doc_id, source, {WORDS.format('text')} AS ws FROM documents), sets AS (SELECT doc_id, source, len(ws) AS nw, {GRAMS.format('ws')} AS gs FROM words), grams AS (SELECT doc_id, source, len(gs) AS n, unnest(gs) AS g FROM sets WHERE nw >= 4)"
DOC_PAIRS = f"{DOC_GRAMS}, shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND a.source <> b.source GROUP BY ALL), pairs AS (SELECT a, b, i / (na + nb - i) AS j FROM shared)"
PART_TEXT = "concat(CASE p_size % 3 WHEN 0 THEN 'Always use ' WHEN 1 THEN 'Never use ' ELSE 'Look at ' END, p_name, ' in ', lower(p_type), ' builds. Keep it short.')"
NEG, POS = r"(?i)\b(?:never|don''?t|do not|avoid|must not|no)\b".replace("''", "''"), r"(?i)\b(?:always|must|prefer|use|do)\b"
PART_RULES = f"rules AS (SELECT p_brand AS repo_id, p_partkey AS rule_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ord, {PART_TEXT} AS text FROM part)"
URL_PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"
EVENT_FINDINGS = "(SELECT concat('r', user_id % 997) AS repo_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' WHEN 'purchase' THEN 'warn' ELSE 'info' END AS severity, CASE event_type WHEN 'error' THEN 'stale-reference' WHEN 'click' THEN 'duplication' WHEN 'purchase' THEN 'drift' WHEN 'view' THEN 'budget' ELSE 'structure' END AS category, concat('line ', event_id, ' of user ', user_id, ' has ', event_type) AS message, event_id, user_id FROM events)"


# ---- rows that stand in for surfaces, rules and findings

def doc_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.lit("r").alias("repo_id"), F.col("doc_id").alias("rule_id"), F.col("doc_id").alias("ord"), F.col("source").alias("surface_id"), "text")


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    size = F.col("p_size") % 3
    text = F.concat(F.when(size == 0, "Always use ").when(size == 1, "Never use ").otherwise("Look at "), "p_name", F.lit(" in "), F.lower("p_type"), F.lit(" builds. Keep it short."))
    turn = Window.partitionBy("p_brand").orderBy("p_partkey")
    return p.select(F.col("p_brand").alias("repo_id"), F.col("p_partkey").alias("rule_id"), F.row_number().over(turn).alias("ord"), F.lit("s").alias("surface_id"), text.alias("text"))


def url_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.lit("r").alias("repo_id"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path")).filter("path <> ''")


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % 997).cast("string")).alias("repo_id"), F.when(kind == "error", "error").when(kind.isin("click", "purchase"), "warn").otherwise("info").alias("severity"),
        F.when(kind == "error", "stale-reference").when(kind == "click", "duplication").when(kind == "purchase", "drift").when(kind == "view", "budget").otherwise("structure").alias("category"),
        F.concat(F.lit("line "), F.col("event_id").cast("string"), F.lit(" of user "), F.col("user_id").cast("string"), F.lit(" has "), kind).alias("message"), "event_id", "user_id",
    )


# ---- words, shingles, similarity

@query(f"WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents) SELECT doc_id, len(ws)::BIGINT AS n_words, md5(array_to_string(ws, ' ')) AS words_hash FROM w")
def normalize_words(spark, sf_dir):
    w = read(spark, sf_dir, "documents").select("doc_id", T.normalize_words(F.col("text")).alias("ws"))
    return w.select("doc_id", long(F.size("ws")).alias("n_words"), F.md5(F.array_join("ws", " ").cast("binary")).alias("words_hash"))


@query(f"WITH {DOC_GRAMS} SELECT doc_id, len(gs)::BIGINT AS n_shingles FROM sets")
def shingle_counts(spark, sf_dir):
    return SIM.with_shingles(doc_rules(spark, sf_dir)).select(F.col("rule_id").alias("doc_id"), long("n").alias("n_shingles"))


def doc_pairs(spark, sf_dir, least):
    sets = SIM.long_enough(SIM.with_shingles(doc_rules(spark, sf_dir)))
    return SIM.similar_pairs(sets.select("repo_id", F.col("rule_id").alias("id"), "ord", F.col("surface_id").alias("grp"), "n", "words", "tokens"), least)


@query(f"WITH {DOC_PAIRS} SELECT a, b, round(j, 6) AS j FROM pairs WHERE j >= 0.9")
def duplicate_pairs(spark, sf_dir):
    return doc_pairs(spark, sf_dir, SIM.DUPLICATE).select("a", "b", F.round("j", 6).alias("j"))


@query(f"WITH {DOC_PAIRS} SELECT a, b, round(j, 6) AS j FROM pairs WHERE j >= 0.6 AND j < 0.9")
def drift_pairs(spark, sf_dir):
    return doc_pairs(spark, sf_dir, SIM.DRIFT).filter(F.col("j") < SIM.DUPLICATE).select("a", "b", F.round("j", 6).alias("j"))


@query(f"WITH w AS (SELECT doc_id, doc_id % {len(KINDS)} AS rank, source, md5(array_to_string({WORDS.format('text')}, ' ')) AS h FROM documents) SELECT h AS words_hash, count(*)::BIGINT AS copies, arg_min(doc_id, struct_pack(r := rank, s := source, d := doc_id)) AS winner FROM w GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_winner(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    w = read(spark, sf_dir, "documents").select("doc_id", W.kind_rank(kind).alias("rank"), "source", F.md5(F.array_join(T.normalize_words(F.col("text")), " ").cast("binary")).alias("words_hash"))
    return w.groupBy("words_hash").agg(F.count("*").alias("copies"), F.min_by("doc_id", F.struct("rank", "source", "doc_id")).alias("winner")).filter("copies > 1")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents), h AS (SELECT doc_id, pos, substr(sha1(line), 1, 12) AS m FROM l WHERE trim(line) <> '') SELECT doc_id, pos::BIGINT AS line, concat(doc_id, ':', m, CASE WHEN n > 1 THEN concat('.', n) ELSE '' END) AS rule_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, m ORDER BY pos) AS n FROM h)")
def occurrence_ids(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).filter(F.trim("text") != "").withColumn("m", T.short_hash(F.col("text")))
    n = F.row_number().over(Window.partitionBy("doc_id", "m").orderBy("pos"))
    return lines.withColumn("k", n).select("doc_id", long(F.col("pos") + 1).alias("line"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), "m", F.when(F.col("k") > 1, F.concat(F.lit("."), F.col("k").cast("string"))).otherwise("")).alias("rule_id"))


@query(f"WITH {DOC_GRAMS}, shared AS (SELECT a.source, a.doc_id AS x, b.doc_id AS y, a.n AS na, b.n AS nb, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.source = b.source AND a.doc_id < b.doc_id GROUP BY ALL), t AS (SELECT source, sum(i / (na + nb - i)) AS total FROM shared GROUP BY 1), c AS (SELECT source, count(*) AS files FROM sets WHERE nw >= 4 GROUP BY 1) SELECT source, files::BIGINT AS files, round(coalesce(total, 0) / (files * (files - 1) / 2), 9) AS mean FROM c LEFT JOIN t USING (source)")
def sprawl_overlap(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.col("doc_id").alias("id"), "text")
    sets = SIM.with_shingles(d).filter(F.size("words") >= SIM.LEAST_WORDS)
    return U.mean_overlap(sets.select("repo_id", "id", "n", "words")).select(F.col("repo_id").alias("source"), "files", F.round("mean", 9).alias("mean"))


# ---- sentences, polarity, contradiction

@query(f"WITH {PART_RULES} SELECT repo_id, rule_id, pos::BIGINT AS pos, trim(s) AS sentence, CASE WHEN regexp_matches(s, '{NEG}') THEN 'negative' WHEN regexp_matches(s, '{POS}') THEN 'positive' ELSE 'none' END AS polarity FROM (SELECT repo_id, rule_id, unnest(x) AS s, unnest(range(0, len(x))) AS pos FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM rules))")
def polarity_rules(spark, sf_dir):
    each = part_rules(spark, sf_dir).select("repo_id", "rule_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return each.select("repo_id", "rule_id", long("pos").alias("pos"), "sentence", T.polarity(F.col("sentence")).alias("polarity"))


@query(f"""
WITH {PART_RULES}, said AS (SELECT repo_id, rule_id, ord, string_split(text, '. ')[1] AS s FROM rules),
polar AS (SELECT *, CASE WHEN regexp_matches(s, '{NEG}') THEN 'negative' WHEN regexp_matches(s, '{POS}') THEN 'positive' ELSE 'none' END AS p, {WORDS.format('s')}[1:9] AS ws FROM said),
content AS (SELECT *, list_filter(ws, lambda w: NOT list_contains({sql_list(T.STOPWORDS + T.POLARITY_WORDS)}, w)) AS cs FROM polar WHERE p <> 'none'),
pairs AS (SELECT repo_id, rule_id, ord, p, unnest(list_distinct(list_transform(range(1, len(cs)), lambda i: cs[i] || ' ' || cs[i + 1]))) AS g FROM content)
SELECT a.repo_id, a.rule_id AS a, b.rule_id AS b, count(*)::BIGINT AS shared FROM pairs a JOIN pairs b ON a.repo_id = b.repo_id AND a.g = b.g AND a.p <> b.p AND a.ord < b.ord GROUP BY ALL HAVING count(*) >= 2
""")
def contradiction_pairs(spark, sf_dir):
    return D.opposed(D.directives(part_rules(spark, sf_dir)))


@query(f"WITH {PART_RULES} SELECT repo_id, kind, count(*)::BIGINT AS n FROM (SELECT repo_id, CASE WHEN regexp_matches(text, '(?i)\\b(?:{T.MODAL_WORDS.replace(chr(39), chr(39) * 2)})\\b') OR regexp_matches(text, '(?i)^(?:{T.IMPERATIVE_STARTS.replace(chr(39), chr(39) * 2)})\\b') THEN 'imperative' WHEN length(text) > 30 THEN 'context' ELSE 'unknown' END AS kind FROM rules) GROUP BY 1, 2")
def rule_kinds(spark, sf_dir):
    return part_rules(spark, sf_dir).withColumn("kind", T.classify_rule(F.col("text"), F.lit(0))).groupBy("repo_id", "kind").agg(F.count("*").alias("n"))


# ---- budgets and structure

@query("SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens_est FROM documents WHERE ceil(length(text) / 4) > 1500")
def surface_budget(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("tokens_est", T.estimate_tokens(F.col("text")))
    return B.long_surfaces(d).select("doc_id", long("tokens_est").alias("tokens_est"))


@query("WITH t AS (SELECT source, sum(ceil(length(text) / 4))::BIGINT AS tokens FROM documents GROUP BY 1) SELECT source, tokens, tokens > 4000 AS over FROM t")
def context_budget(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))
    return d.withColumn("over", F.col("tokens") > B.CONTEXT_TOKENS)


@query(f"WITH {PART_RULES}, n AS (SELECT repo_id, count(*) AS lines, sum(ceil(length(text) / 4)) AS t FROM rules GROUP BY 1) SELECT repo_id, count(*)::BIGINT AS buried, max(ord)::BIGINT AS deepest FROM rules JOIN n USING (repo_id) WHERE t > 300 AND ord / lines > 0.7 AND regexp_matches(text, '(?i)\\b(?:never|always)\\b') GROUP BY 1")
def buried_rules(spark, sf_dir):
    rules = part_rules(spark, sf_dir).withColumns({"start_line": F.col("ord"), "kind": T.classify_rule(F.col("text"), F.lit(0))})
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    surfaces = rules.groupBy("repo_id", "surface_id").agg(raw.alias("raw"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens_est")).withColumn("path", F.col("repo_id"))
    deep = B.buried_rules(rules, surfaces, 300)
    return deep.select("repo_id", long(F.size("buried")).alias("buried"), long(F.element_at("buried", -1)["start_line"]).alias("deepest"))


@query(r"SELECT doc_id, c::BIGINT AS chars FROM (SELECT doc_id, text, length(trim(regexp_replace(regexp_replace(text, '(?m)^#.*$', '', 'g'), '\s+', ' ', 'g'))) AS c FROM documents) WHERE c < 80 AND NOT regexp_matches(text, '`[^`\n]{2,}`')")
def boilerplate_surfaces(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit("other").alias("kind"), F.col("text").alias("raw"))
    return U.boilerplate(d).select("doc_id", long("chars").alias("chars"))


@query("SELECT conv_id::VARCHAR AS repo_id, sum(CASE WHEN turn = 0 THEN ceil(length(text) / 4) ELSE 0 END)::BIGINT AS tokens_always, sum(CASE WHEN turn = 0 THEN 0 ELSE ceil(length(text) / 4) END)::BIGINT AS tokens_conditional, count(*)::BIGINT AS entries FROM conversations GROUP BY 1")
def effective_context_sums(spark, sf_dir):
    """Conversations as repositories: the first turn always loads, the others are rules on request."""
    first = F.col("turn") == 0
    c = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("repo_id"), F.col("turn").cast("string").alias("surface_id"), F.when(first, "AGENTS.md").otherwise(F.concat(F.lit(".cursor/rules/"), F.col("turn").cast("string"), F.lit(".mdc"))).alias("path"),
        F.when(first, "agents-md").otherwise("cursor-rule").alias("kind"), F.lit("repo-root").alias("scope"), T.estimate_tokens(F.col("text")).alias("tokens_est"), F.lit(None).cast(META).alias("meta"),
    )
    told = X.contexts(c, c.select("repo_id", "path")).filter("tool = 'cursor' and directory = '.'")
    return told.select("repo_id", long("tokens_always").alias("tokens_always"), long("tokens_conditional").alias("tokens_conditional"), long(F.size("entries")).alias("entries"))


# ---- paths and references

@query(f"WITH f AS (SELECT DISTINCT {URL_PATH} AS p FROM pages WHERE {URL_PATH} <> ''), x AS (SELECT string_split(p, '/') AS a FROM f) SELECT DISTINCT array_to_string(a[1:i], '/') AS path FROM (SELECT a, unnest(range(1, len(a))) AS i FROM x) UNION SELECT '.' AS path")
def url_dirs(spark, sf_dir):
    return ST.directories(url_files(spark, sf_dir).select("repo_id", "path")).select("path")


@query(f"WITH f AS (SELECT page_id, {URL_PATH} AS p FROM pages WHERE {URL_PATH} <> ''), x AS (SELECT page_id, string_split(p, '/') AS a FROM f), c AS (SELECT page_id, unnest(range(0, len(a))) AS i, a FROM x) SELECT page_id, (len(a) - 1 - i)::BIGINT AS steps, CASE WHEN i = 0 THEN '.' ELSE array_to_string(a[1:i], '/') END AS dir FROM c")
def url_ancestor_chain(spark, sf_dir):
    d = url_files(spark, sf_dir).withColumn("d", P.parent(F.col("path")))
    return d.select("page_id", F.posexplode(P.chain(F.col("d"))).alias("steps", "dir")).select("page_id", long("steps").alias("steps"), "dir")


@query(f"WITH f AS (SELECT page_id, string_split({URL_PATH}, '/') AS a FROM pages WHERE {URL_PATH} <> ''), own AS (SELECT DISTINCT CASE WHEN len(a) = 1 THEN '.' ELSE array_to_string(a[1:len(a) - 1], '/') END AS dir FROM f WHERE page_id % 7 = 0 UNION SELECT '.'), c AS (SELECT page_id, i, CASE WHEN i = 0 THEN '.' ELSE array_to_string(a[1:i], '/') END AS dir FROM (SELECT page_id, a, unnest(range(0, len(a))) AS i FROM f)) SELECT page_id, arg_max(dir, i) AS owner FROM c JOIN own USING (dir) GROUP BY 1")
def nearest_ancestor(spark, sf_dir):
    f = url_files(spark, sf_dir).withColumn("dir", P.parent(F.col("path")))
    owners = f.filter("page_id % 7 = 0").select("repo_id", "dir").unionByName(f.select("repo_id", F.lit(".").alias("dir")).limit(1)).distinct().withColumn("script", F.lit(None).cast("string"))
    near = ST.nearest_scripts(f, owners)
    return f.join(near, ["repo_id", "dir"]).select("page_id", "owner")


@query(f"WITH f AS (SELECT page_id, {URL_PATH} AS p FROM pages WHERE {URL_PATH} <> ''), r AS (SELECT page_id, p || CASE WHEN page_id % 5 = 0 THEN '.gone' ELSE '' END AS ref FROM f) SELECT page_id, ref FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.p = r.ref OR starts_with(f.p, r.ref || '/')) AND NOT EXISTS (SELECT 1 FROM f WHERE regexp_extract(f.p, '[^/]*$') = r.ref)")
def stale_refs(spark, sf_dir):
    f = url_files(spark, sf_dir)
    files = f.select("repo_id", "path").distinct()
    rules = f.select("repo_id", F.lit("s").alias("surface_id"), F.col("page_id").alias("rule_id"), F.lit("text").alias("text"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.array(F.concat("path", F.when(F.col("page_id") % 5 == 0, ".gone").otherwise(""))).alias("refs"))
    surfaces = f.select("repo_id").distinct().withColumns({"surface_id": F.lit("s"), "path": F.lit("AGENTS.md"), "scope": F.lit("repo-root")})
    scripts = f.select("repo_id", F.lit(".").alias("dir"), F.lit("x").alias("script")).limit(0)
    found = ST.staleness(rules, surfaces, files, scripts)
    return found.select(F.col("rule_ids")[0].alias("page_id"), F.col("fix.ref").alias("ref"))


#: What a page looks for, by its number: forms that name no directory, braces, single characters; {n} is a number that some pages have.
LOOKED_FOR = ["**/{n}*", "*/{n}.html", "**/*{n}.html", "{{en,xx}}/{n}*", "*/{n}/**", "??/{n}?", "**/{{{n},x{n}}}"]
SOUGHT = ["(?:[^/]+/)*{n}[^/]*", "[^/]*/{n}[.]html", "(?:[^/]+/)*[^/]*{n}[.]html", "(?:en|xx)/{n}[^/]*", "[^/]*/{n}/.*", "[^/][^/]/{n}[^/]", "(?:[^/]+/)*(?:{n}|x{n})"]
NUMBER = "CAST(page_id * 7 % 997 AS {kind})"


def by_form(forms: list[str], n: str) -> str:
    """An expression of one of some forms, by page_id, with a number's expression put in."""
    told = ["concat('" + f.replace("{n}", f"', {n}, '").replace("{{", "{").replace("}}", "}") + "')" for f in forms]
    return "CASE " + " ".join(f"WHEN page_id % {len(forms)} = {i} THEN {t}" for i, t in enumerate(told)) + " END"


@query(f"""
WITH f AS (SELECT page_id, {URL_PATH} AS p FROM pages WHERE {URL_PATH} <> ''),
g AS (SELECT page_id, {by_form(LOOKED_FOR, NUMBER.format(kind="VARCHAR"))} AS ref, {by_form(SOUGHT, NUMBER.format(kind="VARCHAR"))} AS re FROM f)
SELECT page_id, ref FROM g WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT p FROM f) WHERE regexp_full_match(p, g.re))
""")
def glob_refs(spark, sf_dir):
    """Globs of all pages against the paths of all pages; many match none."""
    f = url_files(spark, sf_dir)
    files = f.select("repo_id", "path").distinct()
    refs = f.select("repo_id", F.col("page_id").alias("rule_id"), F.lit(".").alias("dir"), F.lit("text").alias("text"), F.expr(by_form(LOOKED_FOR, NUMBER.format(kind="STRING"))).alias("ref"))
    return ST.glob_hits(refs, files, ST.directories(files)).select(F.col("rule_id").alias("page_id"), "ref")


# ---- scores, baselines, labels

SCORE_SQL = f"""
WITH f AS {EVENT_FINDINGS}, p AS (SELECT repo_id, CASE category WHEN 'stale-reference' THEN 'freshness' WHEN 'duplication' THEN 'uniqueness' WHEN 'drift' THEN 'consistency' ELSE category END AS subscore, CASE severity WHEN 'error' THEN 25 WHEN 'warn' THEN 10 ELSE 4 END AS penalty, event_id FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, subscore ORDER BY penalty DESC, event_id) AS rn FROM p), s AS (SELECT repo_id, subscore, sum(penalty * pow(0.8, rn - 1)) AS t FROM r GROUP BY 1, 2),
d AS (SELECT * FROM (SELECT DISTINCT concat('r', user_id % 997) AS repo_id FROM events), (VALUES ('freshness', 0.25), ('uniqueness', 0.2), ('consistency', 0.25), ('budget', 0.15), ('structure', 0.15)) w(subscore, weight)),
v AS (SELECT repo_id, subscore, weight, greatest(0, floor(round(100 - coalesce(t, 0), 9) + 0.5)) AS v FROM d LEFT JOIN s USING (repo_id, subscore))
SELECT repo_id, floor(round(sum(v * weight), 9) + 0.5)::BIGINT AS total, max(CASE subscore WHEN 'freshness' THEN v END)::BIGINT AS freshness, max(CASE subscore WHEN 'uniqueness' THEN v END)::BIGINT AS uniqueness,
max(CASE subscore WHEN 'consistency' THEN v END)::BIGINT AS consistency, max(CASE subscore WHEN 'budget' THEN v END)::BIGINT AS budget, max(CASE subscore WHEN 'structure' THEN v END)::BIGINT AS structure FROM v GROUP BY 1
"""


@query(SCORE_SQL)
def severity_score(spark, sf_dir):
    repos = read(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 997).cast("string")).alias("repo_id"))
    s = S.scores(event_findings(spark, sf_dir), repos)
    return s.select("repo_id", *[long(c).alias(c) for c in ("total", *S.WEIGHT)])


@query(f"SELECT repo_id, count(*) FILTER (severity = 'error')::BIGINT AS error, count(*) FILTER (severity = 'warn')::BIGINT AS warn, count(*) FILTER (severity = 'info')::BIGINT AS info FROM {EVENT_FINDINGS} GROUP BY 1")
def severity_counts(spark, sf_dir):
    return S.severity_counts(event_findings(spark, sf_dir))


FINGERPRINT_SQL = "substr(sha1(concat_ws('|', category, concat('u', user_id % 5), concat('p', event_id % 3), regexp_replace(message, '[0-9]+', '#', 'g'))), 1, 12)"


def fingerprinted(spark, sf_dir):
    f = event_findings(spark, sf_dir)
    ids = lambda p, c, n: F.array(F.concat(F.lit(p), (F.col(c) % n).cast("string")))
    return f.withColumn("fingerprint", T.fingerprint(F.col("category"), ids("u", "user_id", 5), ids("p", "event_id", 3), F.col("message")))


@query(f"SELECT repo_id, {FINGERPRINT_SQL} AS fingerprint, count(*)::BIGINT AS n FROM {EVENT_FINDINGS} GROUP BY 1, 2")
def findings_fingerprint(spark, sf_dir):
    return fingerprinted(spark, sf_dir).groupBy("repo_id", "fingerprint").agg(F.count("*").alias("n"))


@query(f"WITH f AS (SELECT repo_id, event_id, {FINGERPRINT_SQL} AS fp FROM {EVENT_FINDINGS}), b AS (SELECT DISTINCT repo_id, fp FROM f WHERE event_id % 9 = 0 UNION SELECT DISTINCT repo_id, 'gone' FROM f), n AS (SELECT repo_id, fp, count(*) AS n FROM f GROUP BY 1, 2) SELECT b.repo_id, coalesce(sum(n.n), 0)::BIGINT AS suppressed, count(*) FILTER (n.n IS NULL)::BIGINT AS stale FROM b LEFT JOIN n ON n.repo_id = b.repo_id AND n.fp = b.fp GROUP BY 1")
def baseline_split(spark, sf_dir):
    f = fingerprinted(spark, sf_dir)
    known = f.filter("event_id % 9 = 0").select("repo_id", "fingerprint").unionByName(f.select("repo_id", F.lit("gone").alias("fingerprint")))
    return S.apply_baseline(f, known)[1].select("repo_id", "suppressed", "stale")


@query(f"WITH f AS (SELECT repo_id, event_id, {FINGERPRINT_SQL} AS fp FROM {EVENT_FINDINGS}) SELECT repo_id, event_id FROM f WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.event_id % 9 = 0 AND b.repo_id = f.repo_id AND b.fp = f.fp)")
def baseline_kept(spark, sf_dir):
    f = fingerprinted(spark, sf_dir)
    return S.apply_baseline(f, f.filter("event_id % 9 = 0").select("repo_id", "fingerprint"))[0].select("repo_id", "event_id")


@query("SELECT d.source, count(*) FILTER (l.quality = 1)::BIGINT AS tp, count(*) FILTER (l.quality = 0)::BIGINT AS fp, count(*) FILTER (l.quality IS NULL)::BIGINT AS unlabeled, CASE WHEN count(l.quality) > 0 THEN count(*) FILTER (l.quality = 1) / count(l.quality) END AS precision FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (d.source)")
def precision_by_source(spark, sf_dir):
    keys = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, "tp").when(F.col("quality") == 0, "fp").alias("label"))
    return S.precision(keys, labels, "source")


@query("SELECT source AS defect, count(*)::BIGINT AS seeded, count(*) FILTER (toxic = 0)::BIGINT AS caught, count(*) FILTER (toxic = 0) / count(*) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def recall_by_source(spark, sf_dir):
    seeded = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("defect"), (F.col("toxic") == 0).alias("caught"))
    return S.recall(seeded)


@query("WITH a AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey + 1000000 FROM customer WHERE c_custkey % 10 = 1), b AS (SELECT c_custkey FROM customer) SELECT c_custkey, 'new' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT c_custkey, 'gone' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def snapshot_drift(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey")
    now = c.filter("c_custkey % 10 <> 0").unionByName(c.filter("c_custkey % 10 = 1").select((F.col("c_custkey") + 1000000).alias("c_custkey")))
    return S.snapshot_drift(now, c)


# ---- compliance

@query(f"WITH dw AS (SELECT doc_id, unnest(list_distinct({WORDS.format('text')})) AS w FROM documents), bw AS (SELECT item_id, unnest(list_distinct(list_filter({WORDS.format('text')}, lambda w: length(w) >= 4 AND NOT list_contains({sql_list(C.STOPWORDS)}, w)))) AS w FROM benchmark)" + " SELECT item_id, doc_id FROM dw JOIN bw USING (w) GROUP BY 1, 2 HAVING count(*) >= 20")
def benchmark_overlap(spark, sf_dir):
    rules = read(spark, sf_dir, "benchmark").select(F.lit("r").alias("repo_id"), F.col("item_id").alias("rule_id"), "text")
    chunks = read(spark, sf_dir, "documents").select(F.lit("r").alias("repo_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("diff"))
    return C.by_keywords(rules, chunks, 20).select(F.col("rule_id").alias("item_id"), F.col("chunk_id").alias("doc_id"))


VERDICT_SQL = "CASE WHEN toxic = 1 THEN 'violated' WHEN quality = 1 THEN 'followed' ELSE 'not-applicable' END"


def judged_labels(spark, sf_dir, second=False):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    v = F.when(F.col("toxic") == 1, "violated").when(F.col("quality") == 1, "followed").otherwise("not-applicable")
    if second:
        v = F.when(F.col("doc_id") % 7 == 0, "followed").otherwise(v)
    broken = F.col("doc_id") % 13 == 0
    return d.select(
        F.lit("r").alias("repo_id"), F.col("source").alias("rule_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("sha"), F.when(~broken, v).alias("verdict"), F.lit("").alias("evidence"),
        F.when(broken, "no answer").alias("error"), F.lit(False).alias("from_cache"),
    )


@query(f"SELECT source AS rule_id, count(*) FILTER (ok AND v <> 'not-applicable')::BIGINT AS applicable, count(*) FILTER (ok AND v = 'followed')::BIGINT AS followed, count(*) FILTER (ok AND v = 'violated')::BIGINT AS violated, count(*) FILTER (NOT ok)::BIGINT AS errors FROM (SELECT source, doc_id % 13 <> 0 AS ok, {VERDICT_SQL} AS v FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def verdict_rollup(spark, sf_dir):
    return C.rule_reports(judged_labels(spark, sf_dir)).select("rule_id", "applicable", "followed", "violated", "errors")


@query(f"WITH a AS (SELECT doc_id, {VERDICT_SQL} AS v FROM documents JOIN labels USING (doc_id) WHERE doc_id % 13 <> 0) SELECT count(*)::BIGINT AS compared, count(*) FILTER (v = CASE WHEN doc_id % 7 = 0 THEN 'followed' ELSE v END)::BIGINT AS agreed, count(*) FILTER (v = CASE WHEN doc_id % 7 = 0 THEN 'followed' ELSE v END) / count(*) AS agreement FROM a")
def agreement(spark, sf_dir):
    return C.agreement(judged_labels(spark, sf_dir), judged_labels(spark, sf_dir, True)).select("compared", "agreed", "agreement")


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def dead_rules(spark, sf_dir):
    rules = read(spark, sf_dir, "documents").select(F.lit("r").alias("repo_id"), F.col("source").alias("rule_id")).distinct()
    return C.dead_rules(rules, judged_labels(spark, sf_dir).unionByName(judged_labels(spark, sf_dir).limit(0)).join(read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("chunk_id")), "chunk_id")).select(F.col("rule_id").alias("source"))


@query("SELECT chunk_id FROM (SELECT lpad(doc_id::VARCHAR, 12, '0') AS chunk_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents JOIN labels USING (doc_id)) WHERE (rn - 1) % 10 = 0")
def calibration_sample(spark, sf_dir):
    one_rule = judged_labels(spark, sf_dir).withColumns({"rule_id": F.lit("r"), "chunk_id": F.lpad("chunk_id", 12, "0")})
    return C.calibration_sample(one_rule, 0.1).select("chunk_id")


@query("SELECT source AS repo_id, count(*)::BIGINT AS pairs, count(*) FILTER (doc_id % 4 = 0)::BIGINT AS cached, (count(*) FILTER (doc_id % 4 <> 0) * 200)::BIGINT AS output_tokens FROM documents GROUP BY 1")
def judge_cost(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), "text", F.lit("0123456789abcdef").alias("sha"), F.array("lang").alias("files"), F.lit("diff").alias("diff"), F.col("doc_id").cast("string").alias("chunk_id"), "doc_id")
    cache = C.with_keys(d.filter("doc_id % 4 = 0"), "m").select("rule_hash", "chunk_id", "model")
    return C.cost(d, cache, "m", 1.0, 5.0).select("repo_id", "pairs", "cached", "output_tokens")


@query()
def pack_chunks(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    diffs = o.select(F.col("o_custkey").cast("string").alias("repo_id"), F.lit(0).alias("ord"), F.col("o_custkey").cast("string").alias("sha"), F.col("o_orderkey").cast("int").alias("pos"), F.col("o_orderkey").cast("string").alias("file"), F.repeat(F.col("o_orderpriority"), (F.col("o_orderkey") % 97).cast("int")).alias("diff"))
    return C.pack_chunks(diffs, 100).select("repo_id", "chunk_id", "files", "tokens_est")


# ---- Python-side operators

#: Word diffs that a task makes, on average.
DIFFS = 2000


@query()
def word_diffs(spark, sf_dir):
    """Each two different texts are compared once; their rows are joined to the result by what tells a text."""
    pairs = settled(doc_pairs(spark, sf_dir, SIM.DRIFT).filter(F.col("j") < SIM.DUPLICATE).select("a", "b"), "drifted")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    words = read(spark, sf_dir, "documents").join(ids, "doc_id", "left_semi").select("doc_id", F.array_join(T.normalize_words(F.col("text")), " ").alias("w"))
    told = settled(words.withColumn("k", F.concat_ws(" ", F.length("w"), F.xxhash64("w"), F.xxhash64(F.reverse("w")))), "words")
    kinds = told.groupBy("k").agg(F.any_value("w").alias("w"))
    named = pairs.join(told.select(F.col("doc_id").alias("a"), F.col("k").alias("ka")), "a").join(told.select(F.col("doc_id").alias("b"), F.col("k").alias("kb")), "b")
    asked = settled(named.select("ka", "kb").distinct(), "asked")
    # a text that many others are compared with is dealt into as many parts as it has blocks of them
    parts = asked.groupBy("kb").agg(F.ceil(F.count("*") / SIM.BLOCK).alias("parts"))
    left = asked.join(parts, "kb").select("ka", "kb", F.pmod(F.xxhash64("ka"), F.col("parts")).alias("part")).join(kinds.select(F.col("k").alias("ka"), F.col("w").alias("wa")), "ka")
    right = kinds.select(F.col("k").alias("kb"), F.col("w").alias("wb")).join(parts, "kb").select("kb", "wb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    # dealt by number: texts of all pairs are few enough to be put into one partition, but diffs take time
    tasks = int(max(4 * spark.sparkContext.defaultParallelism, min(asked.count() // DIFFS, 20_000)))
    both = left.repartition(tasks, "kb", "part").join(right.repartition(tasks, "kb", "part"), ["kb", "part"])

    @F.arrow_udf("string")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([diff_words(p.split(" "), q.split(" ")) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.string())

    return named.join(settled(both.select("ka", "kb", run("wa", "wb").alias("diff")), "diffs"), ["ka", "kb"]).select("a", "b", "diff")


@query()
def markdown_rules(spark, sf_dir):
    d = read(spark, sf_dir, "documents")

    @F.arrow_udf("array<string>")
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([[r["rule_id"] for r in M.rules(t or "", str(i))] for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)], pa.list_(pa.string()))

    return d.select("doc_id", F.posexplode(run("doc_id", "text")).alias("pos", "rule_id"))


#: path, kind, directory it belongs to, whether it loads only under conditions, its front matter's globs, and whether it always applies.
PART_SURFACES = [
    ("AGENTS.md", "agents-md", ".", 0, None, None), ("CLAUDE.md", "claude-md", ".", 0, None, None), ("packages/web/AGENTS.md", "agents-md", "packages/web", 0, None, None), (".cursor/rules/a.mdc", "cursor-rule", ".", 1, None, None),
    (".cursor/rules/b.mdc", "cursor-rule", ".", 0, None, True), (".windsurfrules", "windsurf-rule", ".", 0, None, None), ("packages/web/.cursor/rules/c.mdc", "cursor-rule", "packages/web", 1, "*.md", None),
    (".github/copilot-instructions.md", "copilot-instructions", ".", 0, None, None), ("packages/web/CLAUDE.md", "claude-md", "packages/web", 0, None, None),
]


def surfaces_of_parts(spark, sf_dir):
    """Each brand as a repository; two of three surfaces are there, by the number of its parts."""
    meta = lambda globs, always: f"named_struct('description', null, 'globs', {f"array('{globs}')" if globs else 'null'}, 'always_apply', {'true' if always else 'null'}, 'trigger', null, 'frontmatter_error', null, 'front_matter', null)"
    brands = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("repo_id")).agg(F.count("*").cast("int").alias("n"))
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("path"), F.lit(k).alias("kind"), F.lit("repo-root" if at == "." else "subtree").alias("scope"), F.expr(f"cast({meta(g, a)} as {META})").alias("meta")) for i, (p, k, at, _, g, a) in enumerate(PART_SURFACES)])).alias("k")
    there = brands.select("repo_id", "n", one).select("repo_id", "n", "k.*").filter((F.col("n") + F.col("i")) % 3 != 0)
    return there.withColumns({"surface_id": T.short_hash(F.col("path"), 10), "raw": F.lit(""), "tokens_est": F.col("n") + 10 * F.col("i")}).drop("n", "i")


@query(f"""
WITH b AS (SELECT p_brand AS repo_id, count(*) AS n FROM part GROUP BY 1),
k(i, path, kind, place, conditional) AS (VALUES {", ".join(str((i, p, k, at, c)) for i, (p, k, at, c, _, _) in enumerate(PART_SURFACES))}),
s AS (SELECT repo_id, path, kind, place, conditional, n + 10 * i AS tokens FROM b, k WHERE (n + i) % 3 <> 0),
loads(tool, kind) AS (VALUES {", ".join(str((t, k)) for t, k, _ in X.LOADS)}),
dirs AS (SELECT DISTINCT repo_id, '.' AS directory FROM s UNION SELECT repo_id, place FROM s),
e AS (SELECT d.repo_id, tool, directory, path, tokens, conditional FROM dirs d JOIN s USING (repo_id) JOIN loads USING (kind) WHERE place IN ('.', directory)),
g AS (SELECT repo_id, tool, directory, coalesce(sum(tokens) FILTER (conditional = 0), 0) AS always, coalesce(sum(tokens) FILTER (conditional = 1), 0) AS conditional, string_agg(path, ',' ORDER BY path) AS paths FROM e GROUP BY ALL),
a AS (SELECT d.repo_id, t.tool, d.directory, coalesce(always, 0) AS always, coalesce(g.conditional, 0) AS conditional, coalesce(paths, '') AS paths FROM dirs d, (SELECT DISTINCT tool FROM loads) t LEFT JOIN g ON g.repo_id = d.repo_id AND g.tool = t.tool AND g.directory = d.directory)
SELECT a.repo_id, a.tool, a.directory, a.always::BIGINT AS tokens_always, a.conditional::BIGINT AS tokens_conditional FROM a JOIN a AS r ON r.repo_id = a.repo_id AND r.tool = a.tool AND r.directory = '.' WHERE a.directory = '.' OR a.paths <> r.paths
""")
def tool_contexts(spark, sf_dir):
    s = settled(surfaces_of_parts(spark, sf_dir), "surfaces")
    files = s.select("repo_id", "path")
    return X.contexts(s, files).select("repo_id", "tool", "directory", long("tokens_always").alias("tokens_always"), long("tokens_conditional").alias("tokens_conditional"))


VOCABULARY = "byte_bpe_50k.tiktoken"

if importlib.util.find_spec("public_tokenizers"):

    @query()
    def bpe_tokens(spark, sf_dir):
        """Tokens of whole pages by a byte-level vocabulary; tests hold it against the vocabulary's library."""
        import public_tokenizers

        return token_counts(read(spark, sf_dir, "pages"), ["page_id"], "html", load_vocabulary(public_tokenizers.path(VOCABULARY)))


@query()
def applied_fixes(spark, sf_dir):
    rules = part_rules(spark, sf_dir)
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    surfaces = rules.groupBy("repo_id").agg(raw.alias("raw")).withColumn("path", F.lit("AGENTS.md"))
    edit = F.struct(F.lit("delete").alias("type"), F.col("ord").alias("start_line"), F.col("ord").alias("end_line"), F.lit(None).cast("string").alias("find"), F.lit(None).cast("string").alias("replace_with"))
    fixes = rules.filter("rule_id % 10 = 0").select("repo_id", F.lit(True).alias("safe"), F.lit("AGENTS.md").alias("file"), edit.alias("edit"))
    return W.apply_plan(fixes, surfaces).select("repo_id", F.md5(F.col("after").cast("binary")).alias("after_hash"), F.length("diff").alias("n_diff"))


# ---- surfaces, manifests, markers, seeds, judging

SURFACE_NAMES = ["AGENTS.md", "CLAUDE.md", ".cursor/rules/style.mdc", ".github/copilot-instructions.md", ".windsurfrules", ".windsurf/rules/style.md", "SKILL.md", "README.md"]
SURFACE_PATH = f"CASE WHEN page_id % 3 = 0 OR NOT contains({URL_PATH}, '/') THEN '' ELSE regexp_extract({URL_PATH}, '^(.*/)', 1) END || {sql_list(SURFACE_NAMES)}[page_id % {len(SURFACE_NAMES)} + 1]"


@query(f"""
WITH s AS (SELECT page_id, {SURFACE_PATH} AS path FROM pages WHERE {URL_PATH} <> ''), b AS (SELECT *, regexp_extract(path, '[^/]*$') AS base, len(string_split(path, '/')) AS depth FROM s),
k AS (SELECT *, CASE WHEN base = 'AGENTS.md' THEN 'agents-md' WHEN base = 'CLAUDE.md' THEN 'claude-md' WHEN suffix(path, '.mdc') THEN 'cursor-rule' WHEN path = '.github/copilot-instructions.md' THEN 'copilot-instructions'
WHEN base = '.windsurfrules' OR contains(path, '.windsurf/rules/') THEN 'windsurf-rule' WHEN base = 'SKILL.md' THEN 'skill' ELSE 'other' END AS kind FROM b)
SELECT page_id, path, kind, CASE kind WHEN 'agents-md' THEN depth = 1 WHEN 'claude-md' THEN depth = 1 WHEN 'cursor-rule' THEN depth = 3 WHEN 'windsurf-rule' THEN depth = CASE WHEN contains(path, '.windsurf/rules/') THEN 3 ELSE 1 END ELSE true END AS rooted,
CASE kind WHEN 'agents-md' THEN '{','.join(R.AGENTS_TOOLS)}' WHEN 'claude-md' THEN 'claude-code' WHEN 'skill' THEN 'claude-code' WHEN 'cursor-rule' THEN 'cursor' WHEN 'copilot-instructions' THEN 'copilot' WHEN 'windsurf-rule' THEN 'windsurf' ELSE '' END AS tools FROM k
""")
def surface_kinds(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, SURFACE_NAMES)), (F.col("page_id") % len(SURFACE_NAMES) + 1).cast("int"))
    f = url_files(spark, sf_dir).withColumn("path", P.join(F.when(F.col("page_id") % 3 == 0, ".").otherwise(P.parent(F.col("path"))), name))
    kind = R.kind_of(F.col("path"))
    return f.select("page_id", "path", kind.alias("kind"), (R.scope_of(F.col("path"), kind) == "repo-root").alias("rooted"), F.array_join(R.tools_of(kind), ",").alias("tools"))


MENTIONS = "page_id % 4 = 0"


@query(f"""
WITH s AS (SELECT page_id, {SURFACE_PATH} AS path FROM pages WHERE {URL_PATH} <> ''),
u AS (SELECT page_id, path FROM s WHERE regexp_extract(path, '[^/]*$') NOT IN ('AGENTS.md', 'CLAUDE.md', 'SKILL.md', '.windsurfrules') AND NOT ends_with(path, '.mdc') AND path <> '.github/copilot-instructions.md' AND NOT contains(path, '.windsurf/rules/'))
SELECT page_id, path || ' is loaded by no known tool (legacy format, assumed). Move its rules and delete it.' AS message FROM u
UNION ALL SELECT page_id, path || ':3-4 refers to ~/.claude/, which teammates don' || chr(39) || 't have. Move it into the repository.' FROM s WHERE {MENTIONS}
""")
def load_semantics(spark, sf_dir):
    """Surfaces of pages that no tool loads, and rules of every fourth that refer to a user's own folder."""
    name = F.element_at(F.array(*map(F.lit, SURFACE_NAMES)), (F.col("page_id") % len(SURFACE_NAMES) + 1).cast("int"))
    f = url_files(spark, sf_dir).withColumn("path", P.join(F.when(F.col("page_id") % 3 == 0, ".").otherwise(P.parent(F.col("path"))), name))
    kind = R.kind_of(F.col("path"))
    kinds = settled(f.withColumn("kind", kind), "kinds")
    kind = F.col("kind")
    surfaces = kinds.select("repo_id", F.col("page_id").cast("string").alias("surface_id"), "path", "kind", R.scope_of(F.col("path"), kind).alias("scope"), R.tools_of(kind).alias("tools"), F.lit("").alias("raw"))
    text = F.when(F.expr(MENTIONS), "See ~/.claude/notes.md").otherwise("See ~/claude/notes.md")
    rules = f.select("repo_id", F.col("page_id").cast("string").alias("surface_id"), F.col("page_id").alias("rule_id"), text.alias("text"), F.lit(3).alias("start_line"), F.lit(4).alias("end_line"))
    return U.structure(surfaces, rules).filter("category = 'load-semantics'").select(F.col("surface_ids")[0].cast("bigint").alias("page_id"), "message")


#: Where a page's file is (some with an ending that references leave out), and what a rule refers to, from the root or from its directory.
FILE_OF = "regexp_replace(path, '/$', '')"
REF_OF = "CASE page_id % 4 WHEN 0 THEN q WHEN 1 THEN concat('./', b) WHEN 2 THEN concat(q, '9') ELSE concat('xx/', b) END"


@query(rf"""
WITH f AS (SELECT page_id, regexp_replace({URL_PATH}, '/$', '') AS q FROM pages WHERE contains({URL_PATH}, '/')),
g AS (SELECT page_id, q, regexp_extract(q, '[^/]*$') AS b, regexp_replace(q, '/?[^/]*$', '') AS dir FROM f),
i AS (SELECT DISTINCT q || CASE WHEN page_id % 3 = 0 THEN '.md' ELSE '' END AS p FROM g),
dirs AS (SELECT DISTINCT array_to_string(a[1:k], '/') AS d FROM (SELECT a, unnest(range(1, len(a))) AS k FROM (SELECT string_split(p, '/') AS a FROM i))),
r AS (SELECT page_id, {REF_OF} AS ref, CASE WHEN page_id % 2 = 0 OR dir = '' THEN '' ELSE dir END AS dir FROM g),
c AS (SELECT page_id, ref, unnest([CASE WHEN dir = '' THEN '' ELSE dir || '/' END || regexp_replace(ref, '^[.]/', ''), regexp_replace(ref, '^[.]/', ''), CASE WHEN dir = '' THEN '' ELSE regexp_extract(dir, '^[^/]*') || '/' END || regexp_replace(ref, '^[.]/', '')]) AS cand FROM r),
hit AS (SELECT DISTINCT page_id FROM c WHERE cand IN (SELECT p FROM i) OR cand IN (SELECT d FROM dirs) OR (NOT regexp_matches(ref, '(?i)\.[a-z0-9]{{1,10}}$') AND cand || '.md' IN (SELECT p FROM i))),
strong AS (SELECT * FROM r WHERE starts_with(ref, './') OR regexp_matches(ref, '(?i)\.[a-z0-9]{{1,10}}$') OR regexp_extract(ref, '^[^/]*') IN (SELECT d FROM dirs) OR CASE WHEN dir = '' THEN '' ELSE dir || '/' END || regexp_extract(ref, '^[^/]*') IN (SELECT d FROM dirs))
SELECT page_id, ref FROM strong WHERE page_id NOT IN (SELECT page_id FROM hit)
""")
def weak_refs(spark, sf_dir):
    """References from the root and from directories, with endings left out, to what isn't there, and from unknown directories."""
    f = url_files(spark, sf_dir).filter(F.contains("path", F.lit("/"))).withColumn("q", F.expr(FILE_OF)).withColumns({"b": P.basename(F.col("q")), "dir": P.parent(F.col("q"))})
    files = f.select("repo_id", F.concat("q", F.when(F.col("page_id") % 3 == 0, ".md").otherwise("")).alias("path")).distinct()
    at = F.when(F.col("page_id") % 2 == 0, ".").otherwise(F.col("dir"))
    own = f.withColumns({"surface_id": F.concat(F.lit("at "), at), "ref": F.expr(REF_OF)})
    rules = own.select("repo_id", "surface_id", F.col("page_id").alias("rule_id"), F.lit("text").alias("text"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.array("ref").alias("refs"))
    surfaces = own.select("repo_id", "surface_id", P.join(at, F.lit("AGENTS.md")).alias("path"), F.lit("subtree").alias("scope")).distinct()
    scripts = f.select("repo_id", F.lit(".").alias("dir"), F.lit("x").alias("script")).limit(0)
    return ST.staleness(rules, surfaces, files, scripts).select(F.col("rule_ids")[0].alias("page_id"), F.col("fix.ref").alias("ref"))


#: Front matter of rule files by a part's number: strict, lenient, typed, unknown values, broken, none.
HEADS = [
    "---\\ndescription: part {n}\\nglobs: src/**/*.{{ts,tsx}}, docs/{n}.md\\nalwaysApply: false\\n---\\n", "---\\nglobs: *.md\\nalwaysApply: true\\n---\\n", "---\\ntrigger: glob\\nglobs: [a/**, b/{n}]\\n---\\n",
    "---\\ntrigger: sometimes\\nalwaysApply: maybe\\n---\\n", "---\\ndescription: [{n}\\nother: x\\n---\\n", "",
]
RAW_OF = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS)) + " END"


def raw_of(newline: str) -> str:
    told = RAW_OF.replace("{n}", "' || p_partkey || '").replace("{{", "{").replace("}}", "}").replace("\\n", f"' || {newline} || '")
    return f"({told}) || '- Always keep part ' || p_partkey || ' small.' || {newline} || '- Never drop it.'"


@query(rf"""
WITH r AS (SELECT p_partkey, p_partkey % 6 AS k, {raw_of("chr(10)")} AS raw FROM part),
g AS (SELECT *, regexp_extract(raw, 'globs: ([^\n]*)', 1) AS g FROM r)
SELECT p_partkey, CASE WHEN k = 0 THEN regexp_replace(g, ', ', '|') WHEN g = '' THEN NULL ELSE regexp_replace(regexp_replace(g, '[\[\]]', '', 'g'), ', ', '|') END AS globs,
  nullif(regexp_extract(raw, 'alwaysApply: (true|false)\n', 1), '') AS always_apply, nullif(regexp_extract(raw, 'trigger: (always_on|manual|model_decision|glob)\n', 1), '') AS trigger,
  regexp_matches(raw, 'description: [a-z]') AS described, contains(raw, 'description: [') AS broken, 2::BIGINT AS n_rules, (len(raw) - len(replace(raw, chr(10), '')) + 1)::BIGINT AS last_line FROM g
""")
def front_matter_kinds(spark, sf_dir):
    """Rule files of parts: what their front matter says, and their rules at their lines."""
    d = read(spark, sf_dir, "part").withColumn("n", F.col("p_partkey") % 6)
    kind = F.when(F.col("n").isin(2, 3), "windsurf-rule").otherwise("cursor-rule")
    raw = F.expr(raw_of("char(10)"))
    surfaces = d.select(F.lit("r").alias("repo_id"), F.col("p_partkey").cast("string").alias("surface_id"), F.concat(F.lit(".cursor/rules/"), F.col("p_partkey").cast("string"), F.lit(".mdc")).alias("path"), kind.alias("kind"), raw.alias("raw"))
    known, rules = R.parse(surfaces)
    counted = rules.groupBy("surface_id").agg(F.count("*").alias("n_rules"), long(F.max("end_line")).alias("last_line"))
    m = F.col("meta")
    return known.join(counted, "surface_id").select(
        F.col("surface_id").cast("bigint").alias("p_partkey"), F.array_join(m["globs"], "|").alias("globs"), m["always_apply"].cast("string").alias("always_apply"), m["trigger"].alias("trigger"), m["description"].isNotNull().alias("described"),
        m["frontmatter_error"].isNotNull().alias("broken"), "n_rules", "last_line",
    )


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END > 2048 THEN 'warn' ELSE 'info' END AS severity FROM documents WHERE octet_length(encode(text)) + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END > 2048 OR doc_id % 10 = 0")
def unreadable_surfaces(spark, sf_dir):
    """Texts as files, every tenth with a byte that is no UTF-8: findings of those above a size limit, or unreadable."""
    content = F.col("text").cast("binary")
    content = F.when(F.col("doc_id") % 10 == 0, F.concat(content, F.unhex(F.lit("FF")))).otherwise(content)
    tree = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("repo_id"), F.lit("AGENTS.md").alias("path"), content.alias("content")).withColumn("length", F.length("content"))
    return R.discovery_findings(tree, tree.limit(0), max_bytes=2048).select(F.col("repo_id").alias("doc_id"), "severity")


@query("WITH m AS (SELECT c_custkey, c_custkey % 4 AS k FROM customer WHERE c_custkey % 4 <> 3) SELECT c_custkey, 'packages/p' || k AS dir, unnest(CASE k WHEN 0 THEN ['(manifest)', 'build', 'test-' || c_custkey] ELSE ['(manifest)'] END) AS script FROM m WHERE k <> 2")
def manifest_scripts(spark, sf_dir):
    """Manifests with scripts, without any, broken, and files that are no manifest."""
    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit('{"scripts": {"build": "make", "test-'), key, F.lit('": "run"}}'))).when(k == 1, '{"name": "x"}').when(k == 2, '{"scripts": {').otherwise('{"scripts": {"no": "x"}}')
    name = F.when(k == 3, "other.json").otherwise("package.json")
    tree = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id"), F.concat(F.lit("packages/p"), k.cast("string"), F.lit("/"), name).alias("path"), text.cast("binary").alias("content"))
    return R.scripts(tree).select(F.col("repo_id").alias("c_custkey"), "dir", F.coalesce("script", F.lit("(manifest)")).alias("script"))


MARKED = "(CASE p_size % 4 WHEN 0 THEN '<!-- rulegrain-ignore -->' WHEN 1 THEN 'see <!-- rulegrain-ignore -->' WHEN 2 THEN '  <!--rulegrain-ignore-->  ' ELSE '' END || chr(10) || p_name || CASE WHEN p_partkey % 10 = 0 THEN ' <!-- rulegrain-ignore -->' ELSE '' END || chr(10) || p_type)"


@query(f"WITH l AS (SELECT p_partkey, string_split({MARKED}, chr(10)) AS x FROM part) SELECT p_partkey, 2::BIGINT AS line FROM l WHERE contains(x[2], 'rulegrain-ignore') OR regexp_matches(x[1], '^\\s*<!--\\s*rulegrain-ignore\\s*-->\\s*$') UNION ALL SELECT p_partkey, 3::BIGINT AS line FROM l WHERE contains(x[3], 'rulegrain-ignore') OR regexp_matches(x[2], '^\\s*<!--\\s*rulegrain-ignore\\s*-->\\s*$')")
def ignored_lines(spark, sf_dir):
    p = read(spark, sf_dir, "part").selectExpr("'r' AS repo_id", "p_partkey AS surface_id", f"{MARKED} AS raw")
    rules = p.select("repo_id", "surface_id", F.explode(F.array(F.lit(2), F.lit(3))).alias("start_line")).withColumns({"end_line": F.col("start_line"), "rule_id": F.struct("surface_id", "start_line")})
    return R.ignored_rules(p, rules).select(F.col("rule_id.surface_id").alias("p_partkey"), long("rule_id.start_line").alias("line"))


EXCEPTION_TEXT = "(CASE p_size % 6 WHEN 0 THEN 'Exception: never use ' WHEN 1 THEN 'When in doubt, avoid ' WHEN 2 THEN 'NEVER use ' WHEN 3 THEN 'Where it fits: ' WHEN 4 THEN 'MUST NOT, if old, keep ' ELSE 'Notify if whenever ' END || p_name)"


def first_at(words: str) -> str:
    words = words.replace("'", "''")
    return f"CASE WHEN regexp_matches(t, '(?i)\\b(?:{words})\\b') THEN length(regexp_extract(t, '(?i)^(.*?)\\b(?:{words})\\b', 1)) + 1 ELSE 0 END"


@query(f"""
WITH s AS (SELECT p_partkey, {EXCEPTION_TEXT} AS t FROM part), f AS (SELECT *, {first_at(T.CONDITIONAL_WORDS)} AS c, {first_at(f"{T.NEGATIVE_WORDS}|{T.POSITIVE_WORDS}")} AS m FROM s)
SELECT p_partkey, regexp_matches(t, '(?i)^\\s*exceptions?\\b') OR (c > 0 AND m > 0 AND c < m) AS excepted, regexp_matches(t, '(?i)\\b(?:{T.CRITICAL_WORDS.replace("'", "''")})\\b') AS critical, regexp_matches(t, '\\b(?:{T.EMPHASIZED_WORDS})\\b') AS emphasized FROM f
""")
def exception_rules(spark, sf_dir):
    p, t = read(spark, sf_dir, "part").selectExpr("p_partkey", f"{EXCEPTION_TEXT} AS t"), F.col("t")
    return p.select("p_partkey", T.is_scoped_exception(t).alias("excepted"), T.is_critical(t).alias("critical"), T.is_emphasized(t).alias("emphasized"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 160 THEN substr(text, 1, 157) || '…' ELSE text END) AS quoted FROM documents")
def quoted_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.quote(F.col("text")).cast("binary")).alias("quoted"))


WINDING = f"(CASE page_id % 4 WHEN 0 THEN {URL_PATH} || '/../index' WHEN 1 THEN './' || {URL_PATH} WHEN 2 THEN '../' || {URL_PATH} ELSE {URL_PATH} || '//.' END)"


@query(f"WITH s AS (SELECT page_id, {WINDING} AS path, list_filter(string_split({URL_PATH}, '/'), lambda x: x <> '' AND x <> '.') AS a FROM pages WHERE {URL_PATH} <> '') SELECT page_id, CASE page_id % 4 WHEN 0 THEN array_to_string(list_concat(a[1:len(a) - 1], ['index']), '/') WHEN 2 THEN '(outside)' ELSE array_to_string(a, '/') END AS path FROM s")
def resolved_paths(spark, sf_dir):
    k, p = F.col("page_id") % 4, F.col("path")
    winding = F.when(k == 0, F.concat(p, F.lit("/../index"))).when(k == 1, F.concat(F.lit("./"), p)).when(k == 2, F.concat(F.lit("../"), p)).otherwise(F.concat(p, F.lit("//.")))
    return url_files(spark, sf_dir).select("page_id", F.coalesce(P.resolve(winding), F.lit("(outside)")).alias("path"))


DIFF_SUFFIXES = ["", "/package-lock.json", ".min.js", "/AGENTS.md", "/.cursor/rules/a.mdc", ".map", ".py"]
DIFF_TEXT = f"('diff --git a/' || {URL_PATH} || ' b/' || {URL_PATH} || chr(10) || '+one' || chr(10) || 'diff --git a/x b/' || {URL_PATH} || {sql_list(DIFF_SUFFIXES)}[page_id % {len(DIFF_SUFFIXES)} + 1] || chr(10) || '+two' || chr(10))"


@query(f"WITH c AS (SELECT page_id, string_split({DIFF_TEXT}, 'diff --git ') AS x FROM pages WHERE {URL_PATH} <> ''), f AS (SELECT page_id, unnest(x[2:]) AS part, unnest(range(0, len(x) - 1)) AS pos FROM c) SELECT page_id, pos::BIGINT AS pos, regexp_extract(part, '^a/(.+?) b/(.+)', 2) AS file, md5('diff --git ' || part) AS diff_hash FROM f WHERE NOT regexp_matches(regexp_extract(part, '^a/(.+?) b/(.+)', 2), '{C.SKIPPED}')")
def diffs_by_file(spark, sf_dir):
    suffix, p = F.element_at(F.array(*map(F.lit, DIFF_SUFFIXES)), (F.col("page_id") % len(DIFF_SUFFIXES) + 1).cast("int")), F.col("path")
    diff = F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n+one\ndiff --git a/x b/"), p, suffix, F.lit("\n+two\n"))
    changes = url_files(spark, sf_dir).select("repo_id", F.lit(0).alias("ord"), F.col("page_id").alias("sha"), diff.alias("diff"))
    return C.file_diffs(changes).select(F.col("sha").alias("page_id"), long("pos").alias("pos"), "file", F.md5(F.col("diff").cast("binary")).alias("diff_hash"))


@query(f"WITH f AS (SELECT page_id, {URL_PATH} AS p FROM pages WHERE {URL_PATH} <> ''), d AS (SELECT DISTINCT array_to_string(a[1:i], '/') AS dir FROM (SELECT a, unnest(range(1, len(a))) AS i FROM (SELECT string_split(p, '/') AS a FROM f))) SELECT dir, page_id FROM d JOIN f ON (p = dir AND length(dir) % 2 = 0) OR (starts_with(p, dir || '/') AND (length(dir) % 2 = 0 OR NOT contains(substr(p, length(dir) + 2), '/')))")
def applicable_paths(spark, sf_dir):
    """Directories as rules, half of them as patterns; pages as changes of one file."""
    f = url_files(spark, sf_dir)
    dirs = ST.directories(f.select("repo_id", "path")).filter("path <> '.'")
    rules = dirs.select("repo_id", F.col("path").alias("rule_id"), F.lit("").alias("text"), F.array(F.concat("path", F.when(F.length("path") % 2 == 0, "/").otherwise("/*"))).alias("refs"))
    chunks = f.select("repo_id", F.col("page_id").alias("chunk_id"), F.array("path").alias("files"), F.lit("").alias("diff"))
    return C.applicable(rules, chunks).select(F.col("rule_id").alias("dir"), F.col("chunk_id").alias("page_id"))


SAID = "(CASE turn % 5 WHEN 0 THEN 'So: {\"verdict\": \"followed\", \"evidence\": \"e' || conv_id || '\"} done' WHEN 1 THEN '{\"verdict\": \"violated\"}' WHEN 2 THEN '{\"verdict\": \"perhaps\"}' WHEN 3 THEN 'followed' ELSE '{\"evidence\": \"x\", \"verdict\": \"not-applicable\"}' END)"


@query(f"WITH s AS (SELECT conv_id, turn, regexp_extract({SAID}, '(?s)(\\{{.*\\}})', 1) AS j FROM conversations), v AS (SELECT *, regexp_extract(j, '\"verdict\": \"([^\"]*)\"', 1) AS v FROM s) SELECT conv_id, turn, v AS verdict, regexp_extract(j, '\"evidence\": \"([^\"]*)\"', 1) AS evidence FROM v WHERE v IN {C.VERDICTS}")
def parsed_verdicts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{SAID} AS said").withColumn("v", C.parse_verdict(F.col("said")))
    return c.filter("v is not null").select("conv_id", "turn", "v.verdict", "v.evidence")


def opinion(prompt: str) -> str:
    """A judge that looks at how a rule begins."""
    said = "followed" if "RULE: Always" in prompt else "violated" if "RULE: Never" in prompt else "unsure"
    return f'{{"verdict": "{said}", "evidence": ""}}'


@query(f"WITH r AS (SELECT p_partkey, {PART_TEXT} AS t FROM part) SELECT p_partkey, p_partkey % 4 = 0 AS from_cache, CASE WHEN p_partkey % 4 = 0 THEN 'not-applicable' WHEN starts_with(t, 'Always') THEN 'followed' WHEN starts_with(t, 'Never') THEN 'violated' ELSE 'error' END AS verdict FROM r")
def judged_rules(spark, sf_dir):
    pairs = part_rules(spark, sf_dir).select("repo_id", "rule_id", "text", F.col("rule_id").cast("string").alias("chunk_id"), F.lit("0123456789abcdef").alias("sha"), F.array(F.lit("a.py")).alias("files"), F.lit("+x").alias("diff"))
    known = C.with_keys(pairs.filter("rule_id % 4 = 0"), "m").select("rule_hash", "chunk_id", "model", F.lit("not-applicable").alias("verdict"), F.lit("").alias("evidence"))
    judged = C.judge(pairs, known, opinion, "m")
    return judged.select(F.col("rule_id").alias("p_partkey"), "from_cache", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("verdict")).alias("verdict"))


@query(f"WITH s AS ({SCORE_SQL}), e AS (SELECT repo_id, count(*) FILTER (severity = 'error')::BIGINT AS errors FROM {EVENT_FINDINGS} GROUP BY 1) SELECT repo_id, errors, total, errors <= 0 AND total >= 50 AS passed FROM s JOIN e USING (repo_id)")
def gated_repositories(spark, sf_dir):
    f = event_findings(spark, sf_dir)
    return S.gate(f, S.scores(f, f.select("repo_id")), 50).select("repo_id", long("errors").alias("errors"), long("total").alias("total"), "passed")


MIDDLE = "list_transform(string_split_regex(text, '\\s+'), lambda w, i: CASE WHEN i = len(string_split_regex(text, '\\s+')) // 2 + 1 THEN 'sideways' ELSE w END)"
SPREAD = "(SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY seed) - 1 AS rn, count(*) OVER (PARTITION BY repo_id) AS c FROM {0})"
TAKEN = "list_contains(list_transform(range(0, least(c, 7)), lambda i: i * c // least(c, 7)), rn)"


def grams_of(words: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) <= 5 THEN [array_to_string({words}, ' ')] ELSE list_distinct(list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i + 4], ' '))) END"


@query(rf"""
WITH f AS (SELECT page_id, {URL_PATH} AS p FROM pages WHERE {URL_PATH} <> ''), t AS (SELECT DISTINCT p FROM f),
refs AS (SELECT 'pages' AS repo_id, p, regexp_replace(p, '/$', '') AS q, page_id || '|' || p AS seed FROM f WHERE regexp_replace(p, '/$', '') IN (SELECT p FROM t)),
lost AS (SELECT * FROM {SPREAD.format("refs")} WHERE {TAKEN}),
stale AS (SELECT repo_id, 'stale-reference' AS defect, NOT EXISTS (SELECT 1 FROM t WHERE t.p <> l.q AND (starts_with(t.p, l.q || '/') OR regexp_extract(t.p, '[^/]*$') = l.p)) AS hit FROM lost l),
long AS (SELECT source AS repo_id, text, doc_id AS seed FROM documents WHERE len(string_split_regex(text, '\s+')) >= 8),
chosen AS (SELECT repo_id, text, array_to_string({MIDDLE}, ' ') AS changed FROM {SPREAD.format("long")} WHERE {TAKEN}),
w AS (SELECT repo_id, {WORDS.format("text")} AS a, {WORDS.format("changed")} AS b FROM chosen),
g AS (SELECT repo_id, len(a) AS n, len(b) AS m, {grams_of("a")} AS ga, {grams_of("b")} AS gb FROM w),
copies AS (SELECT repo_id, 'duplication-verbatim' AS defect, n >= 4 AS hit FROM g UNION ALL SELECT repo_id, 'drift-one-word', n >= 4 AND m >= 4 AND len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) >= 0.6 FROM g)
SELECT repo_id, defect, count(*) AS seeded, count(*) FILTER (hit) AS caught FROM (FROM stale UNION ALL FROM copies) GROUP BY ALL
""")
def seeded_recall(spark, sf_dir):
    """Paths of all pages as references to them, texts of all documents as rules of their sources; seven seeds of each class for each."""
    f = url_files(spark, sf_dir).withColumn("repo_id", F.lit("pages"))
    kinds = lambda df: df.withColumns({"start_line": F.lit(1), "end_line": F.lit(1), "kind": F.lit("imperative")})
    refs = kinds(f.select("repo_id", F.lit("s").alias("surface_id"), F.col("page_id").cast("string").alias("rule_id"), F.lit(0).alias("ord"), F.lit("text").alias("text"), F.array("path").alias("refs")))
    d = read(spark, sf_dir, "documents")
    texts = kinds(d.select(F.col("source").alias("repo_id"), F.lit("s").alias("surface_id"), F.format_string("%012d", "doc_id").alias("rule_id"), F.col("doc_id").cast("int").alias("ord"), "text", F.array().cast("array<string>").alias("refs")))
    rules = refs.unionByName(texts)
    surfaces = rules.select("repo_id").distinct().withColumns({"surface_id": F.lit("s"), "path": F.lit("AGENTS.md"), "scope": F.lit("repo-root"), "tools": F.array(F.lit("codex"))})
    scripts = f.select("repo_id", F.lit(".").alias("dir"), F.lit("x").alias("script")).limit(0)
    return RC.recall(surfaces, rules, f.select("repo_id", "path").distinct(), scripts, 7, 7)


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM r WHERE n <= 7 OR list_contains(list_transform(range(0, 7), lambda i: i * n // 7), rn)")
def spread_documents(spark, sf_dir):
    """A sampling operator: seven documents of each source, evenly spread."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), "doc_id")
    return SD.spread_sample(d, 7, ["doc_id"]).select(F.col("repo_id").alias("source"), "doc_id")


@query(f"WITH {PART_RULES}, w AS (SELECT repo_id, rule_id, regexp_split_to_array(text, '\\s+') AS x FROM rules) SELECT repo_id, 'seeded:' || rule_id AS rule_id, array_to_string(list_concat(x[1:len(x) // 2], ['{SD.REPLACEMENT}'], x[len(x) // 2 + 2:]), ' ') AS text FROM w WHERE len(x) >= {SD.LEAST_WORDS}")
def planted_rules(spark, sf_dir):
    return SD.planted(part_rules(spark, sf_dir), False).select("repo_id", "rule_id", "text")


@query(f"WITH {PART_RULES}, kept AS (SELECT repo_id, ord, CASE WHEN rule_id % 7 = 0 THEN replace(text, ' Keep ', ' Hold ') ELSE text END AS text FROM rules WHERE rule_id % 10 <> 0) SELECT repo_id, md5(string_agg(text, chr(10) ORDER BY ord)) AS after_hash FROM kept GROUP BY 1")
def edited_files(spark, sf_dir):
    """Files of rules, with every tenth deleted and a word that stands alone replaced in every seventh."""
    rules = part_rules(spark, sf_dir)
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    surfaces = rules.groupBy("repo_id").agg(raw.alias("raw")).withColumn("path", F.lit("AGENTS.md"))
    gone = F.col("rule_id") % 10 == 0
    some = lambda v: F.when(~gone, v)
    edit = F.struct(F.when(gone, "delete").otherwise("replace").alias("type"), F.col("ord").alias("start_line"), F.col("ord").alias("end_line"), some("Keep").alias("find"), some("Hold").alias("replace_with"))
    fixes = rules.filter("rule_id % 10 = 0 or rule_id % 7 = 0").select("repo_id", F.lit(True).alias("safe"), F.lit("AGENTS.md").alias("file"), edit.alias("edit"))
    return W.apply_plan(fixes, surfaces).select("repo_id", F.md5(F.col("after").cast("binary")).alias("after_hash"))
