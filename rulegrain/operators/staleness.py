"""References that no longer resolve: each is tried from several directories and anti-joined with the file index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..schema import finding, place
from .globs import matches

# Endings that an import may leave out, and what counts as an ending.
COMPLETIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rs", ".go", ".md")
HAS_EXTENSION = r"(?i)\.[a-z0-9]{1,10}$"
CD = r"(?<![A-Za-z0-9_])cd\s+([A-Za-z0-9_@./-]+)"


def directories(files: DataFrame) -> DataFrame:
    """repo_id, path of every directory that files imply, the root as `.`."""
    above = files.select("repo_id", F.explode(P.proper_ancestors(F.col("path"))).alias("path"))
    return above.unionByName(files.select("repo_id", F.lit(".").alias("path"))).distinct()


def bases(refs: DataFrame, dirs: DataFrame) -> DataFrame:
    """repo_id, rule_id, base: directories that a rule's references may start from.

    The surface's own, those above it, those that the rule changes into, and each one's src where there is one.
    """
    changed = F.transform(F.regexp_extract_all("text", F.lit(CD), 1), lambda d: F.regexp_replace(d, "/$", ""))
    own = refs.select("repo_id", "rule_id", F.explode(F.array_union(P.chain(F.col("dir")), changed)).alias("base")).distinct()
    source = own.withColumn("base", P.join(F.col("base"), F.lit("src"))).join(dirs.withColumnRenamed("path", "base"), ["repo_id", "base"], "left_semi")
    return own.unionByName(source.select("repo_id", "rule_id", "base")).distinct()


def candidates(refs: DataFrame, dirs: DataFrame) -> DataFrame:
    """repo_id, rule_id, ref, candidate, completed: what plain references may mean; candidate is null outside the root."""
    tried = refs.join(bases(refs, dirs), ["repo_id", "rule_id"])
    plain = P.resolve(F.regexp_replace(P.join(F.col("base"), F.col("ref")), "/$", ""))
    one = tried.select("repo_id", "rule_id", "ref", plain.alias("candidate")).distinct()
    completable = ~F.col("ref").rlike(HAS_EXTENSION) & ~F.col("ref").endswith("/") & F.col("candidate").isNotNull() & (F.col("candidate") != "")
    more = one.filter(completable).select("repo_id", "rule_id", "ref", F.explode(F.array(*[F.concat("candidate", F.lit(e)) for e in COMPLETIONS])).alias("candidate"), F.lit(True).alias("completed"))
    return one.withColumn("completed", F.lit(False)).unionByName(more)


def ref_targets(refs: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, rule_id, ref, targets: existing files that plain references resolve to."""
    tried = candidates(refs, directories(files))
    return tried.join(files.withColumnRenamed("path", "candidate"), ["repo_id", "candidate"]).groupBy("repo_id", "rule_id", "ref").agg(F.array_sort(F.collect_set("candidate")).alias("targets"))


def nearest_scripts(places: DataFrame, scripts: DataFrame) -> DataFrame:
    """repo_id, dir, owner: for each place the closest directory at or above it that has a manifest."""
    up = places.select("repo_id", "dir").distinct().select("repo_id", "dir", F.posexplode(P.chain(F.col("dir"))).alias("steps", "owner"))
    owners = scripts.select("repo_id", F.col("dir").alias("owner")).distinct()
    return up.join(owners, ["repo_id", "owner"]).groupBy("repo_id", "dir").agg(F.min_by("owner", "steps").alias("owner"))


def glob_hits(refs: DataFrame, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """repo_id, rule_id, ref of glob references that match a file from one of their bases."""
    tried = refs.join(bases(refs, dirs), ["repo_id", "rule_id"]).select("repo_id", "rule_id", "ref", P.join(F.col("base"), F.col("ref")).alias("glob"))
    hit = matches(tried, files, ["repo_id"]).select("repo_id", "glob").distinct()
    return tried.join(hit, ["repo_id", "glob"], "left_semi").select("repo_id", "rule_id", "ref").distinct()


def staleness(rules: DataFrame, surfaces: DataFrame, files: DataFrame, scripts: DataFrame, truncated: DataFrame | None = None) -> DataFrame:
    """Findings of references to files, patterns and scripts that don't exist.

    scripts: repo_id, dir, script (null for a manifest without scripts). truncated: repo_id of repositories
    whose file index was cut.
    """
    dirs = directories(files)
    at = surfaces.filter("scope <> 'user-global'").select("repo_id", "surface_id", "path", P.parent(F.col("path")).alias("dir"))
    refs = rules.join(at, ["repo_id", "surface_id"]).withColumn("ref", F.explode("refs"))
    ref = F.col("ref")
    script, glob = ref.startswith("npm run "), ref.contains("*") | ref.contains("?")
    weak = ~ref.endswith("/") & ~ref.startswith("./") & ~ref.rlike(HAS_EXTENSION)
    first = F.split(ref, "/")[0]
    # tokens without an ending, and patterns, count only if their first part is a directory here
    known = dirs.withColumnRenamed("path", "first_dir")
    asked = refs.filter(~script).select("repo_id", "rule_id", "ref", F.explode(F.array(first, P.join(F.col("dir"), first))).alias("first_dir"))
    credible = asked.join(known, ["repo_id", "first_dir"], "left_semi").select("repo_id", "rule_id", "ref").distinct().withColumn("credible", F.lit(True))
    marked = refs.join(credible, ["repo_id", "rule_id", "ref"], "left")
    sure = F.col("credible").isNotNull()

    runs = marked.filter(script).join(nearest_scripts(marked.filter(script), scripts), ["repo_id", "dir"])
    name = F.substring("ref", len("npm run ") + 1, 1 << 30)
    has = scripts.select("repo_id", F.col("dir").alias("owner"), F.col("script").alias("name")).filter("name is not null")
    no_script = runs.withColumn("name", name).join(has, ["repo_id", "owner", "name"], "left_anti").withColumn("what", F.concat(F.lit('the npm script "'), "name", F.lit('"')))

    globs = marked.filter(~script & glob & ref.contains("/") & sure)
    no_match = globs.join(glob_hits(globs, files, dirs), ["repo_id", "rule_id", "ref"], "left_anti").withColumn("what", F.concat(F.lit("files matching `"), "ref", F.lit("`")))

    plain = marked.filter(~script & ~glob & (~weak | sure))
    index = files.withColumn("file", F.lit(True)).unionByName(dirs.withColumn("file", F.lit(False))).withColumnRenamed("path", "candidate")
    tried = candidates(plain, dirs).join(index, ["repo_id", "candidate"], "left")
    hit = (F.col("candidate") == "") | (F.col("file").isNotNull() & (F.col("file") | ~F.col("completed")))
    told = tried.groupBy("repo_id", "rule_id", "ref").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("exists"), F.bool_or(F.col("candidate").isNotNull()).alias("judged"))
    names = files.select("repo_id", P.basename(F.col("path")).alias("ref")).distinct()
    missing = told.filter("judged and not exists").join(names, ["repo_id", "ref"], "left_anti").select("repo_id", "rule_id", "ref")
    no_path = plain.join(missing, ["repo_id", "rule_id", "ref"], "left_semi").withColumn("what", F.concat(F.lit("`"), "ref", F.lit("`")))

    cols = ["repo_id", "rule_id", "surface_id", "path", "start_line", "end_line", "text", "ref", "what"]
    stale = no_script.select(cols).unionByName(no_match.select(cols)).unionByName(no_path.select(cols))
    note = F.lit("")
    if truncated is not None:
        stale = stale.join(truncated.select("repo_id", F.lit(True).alias("cut")).distinct(), "repo_id", "left")
        note = F.when(F.col("cut"), " (the file index was cut, so this may be a false alarm)").otherwise("")
    return stale.select(
        "repo_id",
        *finding(
            "error", "stale-reference", F.concat(place(F.col("path"), F.col("start_line"), F.col("end_line")), F.lit(" refers to "), "what", F.lit(", which does not exist. Update or delete the rule."), note),
            F.concat(F.lit('"'), T.quote(F.col("text")), F.lit('"')), F.array("rule_id"), F.array("surface_id"),
            ("update-path", F.concat(F.lit("Point to where "), "what", F.lit(" is now, or delete the reference.")), F.col("ref")),
        ),
    )
