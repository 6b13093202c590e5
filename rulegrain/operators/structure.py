"""Shape of a repository's surfaces: sprawl, empty files, files that nothing loads, references to what only one user has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import finding, place
from ..sources.settled import settled
from .similarity import fixed, with_shingles, with_tokens

PER_TOOL = ("claude-md", "cursor-rule", "copilot-instructions", "windsurf-rule", "other")
LEAST_FILES, LEAST_OVERLAP, LEAST_CHARS = 3, 0.5, 80


#: Shared groups and sizes that a block of a tile holds, on average.
TILE = 1_000_000


def mean_overlap(sets: DataFrame) -> DataFrame:
    """repo_id, files, mean: mean similarity of all pairs of a repository's sets (repo_id, id, n, words); pairs that share nothing count as 0.

    Equal sets are one class that counts as often as it occurs, so copies make no pairs. Shingles that occur in the
    very same classes (told by two 64-bit hashes), as those of one passage do, are one group with a weight. Classes that
    hold the same groups are one profile with their sizes. Profiles lie in blocks of bounded size, and each two blocks
    of a repository are one tile, which sums its pairs where it is: no pair is ever a row.
    """
    spark = sets.sparkSession
    ordered = fixed(with_tokens(sets.select("repo_id", "words")).drop("words"), "held", F.sort_array("tokens"))
    cls = F.concat_ws(" ", F.size("held"), F.xxhash64("held"), F.xxhash64(F.reverse("held")))
    made = settled(ordered.select(F.monotonically_increasing_id().alias("c"), "repo_id", cls.alias("cls"), F.size("held").cast("bigint").alias("n"), F.col("held").alias("tokens")), "overlap")
    kinds = settled(made.groupBy("repo_id", "cls").agg(F.count("*").alias("m"), F.any_value("n").alias("n"), F.min("c").alias("c")).drop("cls"), "kinds")
    one = made.join(kinds.select("c"), "c", "left_semi").select("c", "repo_id", F.explode("tokens").alias("token")).select("c", F.xxhash64("repo_id", "token").alias("key"))
    # not by a number: Spark reads one shuffle twice then, and makes two by number
    dealt = one.repartition("key")
    lists = dealt.groupBy("key").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("c")).alias("h"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("g")).filter("df > 1")
    groups = lists.groupBy("df", "h", "g").agg(F.count("*").alias("weight"), F.min("key").alias("key")).select("key", "weight")
    # hashed, as sorting all shingles to meet the few groups would spill them
    held = dealt.join(groups.hint("shuffle_hash"), "key").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("key", "weight"))).alias("held"))
    sizes = held.join(kinds, "c").groupBy("repo_id", "held", "n").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("squares"))
    listed = sizes.groupBy("repo_id", "held").agg(F.collect_list(F.struct("n", "m", "squares")).alias("size"))
    told = listed.select("repo_id", *(F.col(f"held.{x}").alias(x) for x in ("key", "weight")), *(F.col(f"size.{x}").alias(x) for x in ("n", "m", "squares")))
    profiles = settled(told, "profiles")
    held_by = F.sum(F.size("key") + F.size("n"))
    blocks = settled(profiles.groupBy("repo_id").agg(F.ceil(held_by / TILE).alias("blocks"), held_by.alias("held")), "blocks")
    tiles, sent = blocks.agg(F.coalesce(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.lit(1)), F.coalesce(F.sum(F.col("held") * F.col("blocks")), F.lit(0))).first()
    # dealt by number: tiles are small, so partitions would be put together, but their sums take time
    tasks = int(min(2 * tiles, 4 * spark.sparkContext.defaultParallelism + sent // TILE))
    in_blocks = profiles.join(blocks.drop("held"), "repo_id").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    met = in_blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("blocks", "other")
    between = met.repartition(tasks, "repo_id", "a", "b").groupBy("repo_id", "a", "b").applyInArrow(tile_sum, "repo_id string, j double").select("repo_id", "j")
    # no words: like nothing, not even another one
    within = kinds.select("repo_id", F.when(F.col("n") == 0, 0.0).otherwise(F.col("m") * (F.col("m") - 1) / 2).alias("j"))
    total = between.unionByName(within).groupBy("repo_id").agg(F.sum("j").alias("total"))
    n = kinds.groupBy("repo_id").agg(F.sum("m").alias("files"))
    return n.join(total, "repo_id", "left").select("repo_id", "files", F.when(F.col("files") > 1, F.coalesce("total", F.lit(0.0)) / (F.col("files") * (F.col("files") - 1) / 2)).otherwise(0.0).alias("mean"))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indexes of ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class _Block:
    """Profiles of a block: key and weight of their groups, and n, m and squares of their sizes, as flat arrays with the profiles' bounds."""

    def __init__(self, rows: pa.Table):
        flat = {name: rows[name].combine_chunks() for name in ("key", "weight", "n", "m", "squares")}
        bounds = lambda name: np.concatenate([[0], np.cumsum(np.array(pc.list_value_length(flat[name]), np.int64))])
        self.groups, self.sizes, self.rows = bounds("key"), bounds("n"), rows.num_rows
        self.key, self.weight, self.n = (np.array(flat[name].flatten(), np.int64) for name in ("key", "weight", "n"))
        self.m, self.squares = (np.array(flat[name].flatten(), np.float64) for name in ("m", "squares"))


def tile_sum(rows: pa.Table) -> pa.Table:
    """repo_id, j: the sum of m m' i / (n + n' - i) over all pairs between blocks a and b, or within one."""
    one = rows["a"][0].as_py() == rows["b"][0].as_py()
    x = _Block(rows.filter(pc.equal(rows["block"], rows["a"])))
    y = x if one else _Block(rows.filter(pc.equal(rows["block"], rows["b"])))
    order = np.argsort(y.key, kind="stable")
    keys, owner = y.key[order], np.repeat(np.arange(y.rows), np.diff(y.groups))[order]
    first, count = np.searchsorted(keys, x.key, "left"), np.searchsorted(keys, x.key, "right")
    count -= first
    total, most = 0.0, y.n.max(initial=0) + 1
    for p in range(x.rows):
        of = slice(x.groups[p], x.groups[p + 1])
        n, m = x.n[x.sizes[p] : x.sizes[p + 1]], x.m[x.sizes[p] : x.sizes[p + 1]]
        if one:  # classes of one profile share all its groups
            i, squares = x.weight[of].sum(), x.squares[x.sizes[p] : x.sizes[p + 1]]
            total += ((m * m - squares) / 2 * i / (2 * n - i)).sum()
            for k in range(len(n) - 1):
                total += m[k] * (m[k + 1 :] * i / (n[k] + n[k + 1 :] - i)).sum()
        met, weight = owner[_ranges(first[of], count[of])], np.repeat(x.weight[of], count[of])
        if 16 * len(met) > y.rows:
            counted = np.bincount(met, weights=weight, minlength=y.rows)
            others = np.flatnonzero(counted)
            shared = counted[others]
        else:
            others, at = np.unique(met, return_inverse=True)
            shared = np.bincount(at, weights=weight)
        if one:  # each two once
            later = np.searchsorted(others, p, "right")
            others, shared = others[later:], shared[later:]
        if not len(others):
            continue
        sizes = y.sizes[others + 1] - y.sizes[others]
        where = _ranges(y.sizes[others], sizes)
        i, s, w = np.repeat(shared, sizes), y.n[where], y.m[where]
        if len(n) > 16:  # what shares as much and is as large counts at once
            same, at = np.unique(i.astype(np.int64) * most + s, return_inverse=True)
            i, s, w = same // most, same % most, np.bincount(at, weights=w)
        wi, rest = w * i, s - i
        for k in range(len(n)):
            total += m[k] * (wi / (rest + n[k])).sum()
    return pa.table({"repo_id": rows["repo_id"][:1], "j": pa.array([total], pa.float64())})


def content_chars(raw):
    """Characters of a text without its heading lines, white space closed up."""
    return F.length(F.trim(F.regexp_replace(F.regexp_replace(raw, "(?m)^#.*$", ""), r"\s+", " ")))


def boilerplate(surfaces: DataFrame) -> DataFrame:
    """Surfaces with hardly any content, chars beside them; imports and commands count as content."""
    imports = (F.col("kind") == "claude-md") & F.col("raw").rlike(r"(?m)^@\S+\s*$")
    command = F.col("raw").rlike(r"`[^`\n]{2,}`")
    return surfaces.withColumn("chars", content_chars(F.col("raw"))).filter((F.col("chars") < LEAST_CHARS) & ~imports & ~command)


def structure(surfaces: DataFrame, rules: DataFrame) -> DataFrame:
    own = surfaces.filter("scope <> 'user-global'")
    rooted = own.filter((F.col("scope") == "repo-root") & F.col("kind").isin(*PER_TOOL))
    sets = with_shingles(rooted, "raw").select("repo_id", F.col("surface_id").alias("id"), "n", "words")
    listed = rooted.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("path", "surface_id"))).alias("all"))
    pct = T.percent(F.col("mean"))
    sprawl = mean_overlap(sets).filter((F.col("files") >= LEAST_FILES) & (F.col("mean") < LEAST_OVERLAP)).join(listed, "repo_id").select(
        "repo_id",
        *finding(
            "info", "structure", F.concat(F.col("files").cast("string"), F.lit(" files for single tools ("), F.array_join(F.transform("all", lambda x: x["path"]), ", "), F.lit(") overlap by only "), pct, F.lit("%. Move shared rules to AGENTS.md.")),
            F.concat(F.lit("mean overlap of pairs "), pct, F.lit("%")), surface_ids=F.transform("all", lambda x: x["surface_id"]), fix=("rewrite", "Move shared rules to AGENTS.md and keep what is a tool's own."),
        ),
    )
    shown = F.concat(F.lit('"'), F.substring(F.trim(F.regexp_replace("raw", r"\s+", " ")), 1, 120), F.lit('"'))
    empty = boilerplate(own).select("repo_id", *finding("info", "structure", F.concat("path", F.lit(" is empty or boilerplate ("), F.col("chars").cast("string"), F.lit(" characters of content). Fill or delete it.")), shown, surface_ids=F.array("surface_id")))
    unread = own.filter(F.size("tools") == 0).select("repo_id", *finding("info", "load-semantics", F.concat("path", F.lit(" is loaded by no known tool (legacy format, assumed). Move its rules and delete it.")), F.concat(F.lit("kind: "), "kind"), surface_ids=F.array("surface_id")))
    private = rules.filter(F.contains("text", F.lit("~/.claude/"))).join(own.select("repo_id", "surface_id", "path"), ["repo_id", "surface_id"]).select(
        "repo_id",
        *finding(
            "info", "load-semantics", F.concat(place(F.col("path"), F.col("start_line"), F.col("end_line")), F.lit(" refers to ~/.claude/, which teammates don't have. Move it into the repository.")),
            F.concat(F.lit('"'), F.substring("text", 1, 160), F.lit('"')), F.array("rule_id"), F.array("surface_id"),
        ),
    )
    return sprawl.unionByName(empty).unionByName(unread).unionByName(private)
