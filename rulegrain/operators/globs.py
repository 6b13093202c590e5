"""Many globs against many files, as equi-joins.

A glob names something literal that each of its files has: the directory that it begins with or a directory
further in, and a file name or its ending. That is its key. Files tell all keys that they could be asked for,
and meet only the globs with one of theirs, whose patterns are then matched. Globs without a key are few in
kind: of those with three literal characters somewhere, three are the key; those without any literal depend
on a path's shape alone, and meet each shape once; what is left (one or two literal characters between
wildcards) meets its scope's distinct paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources.settled import settled

#: Braces up to which a glob's alternatives are told apart for their keys; beyond, they could be too many.
MOST_BRACES = 6
GRAM = 3
BETWEEN = "\x00"


def alternatives(glob: Column) -> Column:
    """A glob's expansions, the innermost braces first; one with more than MOST_BRACES braces is its only one."""
    inner = r"(?s)^(.*?)\{([^{}]*)\}(.*)$"

    def spread(g: Column) -> Column:
        part = lambda i: F.regexp_extract(g, inner, i)
        return F.when(g.rlike(inner), F.transform(F.split(part(2), ",", -1), lambda x: F.concat(part(1), x, part(3)))).otherwise(F.array(g))

    n = F.length(glob) - F.length(F.translate(glob, "{", ""))
    rounds = F.when((n > 0) & (n <= MOST_BRACES), F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.aggregate(rounds, F.array(glob), lambda acc, _: F.flatten(F.transform(acc, spread))))


def _wild(s: Column) -> Column:
    return s.rlike(r"[*?]")


def _longest(parts: Column) -> Column:
    """The longest of some strings, empty if there is none."""
    return F.coalesce(F.get(F.sort_array(F.transform(parts, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))), asc=False), F.lit(0))["s"], F.lit(""))


def keyed(globs: DataFrame) -> DataFrame:
    """globs (with a column glob), by expansion, with how each is to be met: kind (key, gram, shape or rest) and key."""
    one = globs.withColumn("_x", F.explode(alternatives(F.col("glob")))).withColumn("_s", F.split("_x", "/", -1))
    x, s = F.col("_x"), F.col("_s")
    n = F.size(s)
    whole = ~x.contains("{")  # braces that are left may hold more than one segment
    ahead = F.regexp_extract(x, r"^((?:[^/*?{]+/)*)", 1)
    # `a**/b` is one stretch with an optional slash, so what follows such a segment is no name of its own
    own = lambda i: (i == 0) | ~F.get(s, i - 1).endswith("**") | (F.get(s, i - 1) == "**")
    beyond = F.size(F.split(ahead, "/", -1)) - 1
    further = F.filter(F.transform(s, lambda v, i: F.when((i >= beyond) & (i < n - 1) & (v != "") & ~_wild(v) & own(i), v).otherwise("")), lambda v: v != "")
    inside = F.when(whole, _longest(further)).otherwise("")
    tail = F.element_at(s, -1)
    ending = F.regexp_extract(tail, r"\.([^.*?]+)$", 1)
    last = F.when(~whole, "").when((tail != "") & ~_wild(tail) & own(n - 1), F.concat(F.lit("n:"), tail)).when(ending != "", F.concat(F.lit("e:"), ending)).otherwise("")
    place = F.when(inside != "", F.concat(F.lit("s:"), inside)).when(ahead != "", F.concat(F.lit("p:"), F.regexp_replace(ahead, "/$", ""))).otherwise("")
    literal = _longest(F.filter(F.split(x, r"[*?/]"), lambda v: v != ""))
    kind = (
        F.when((place != "") | (last != ""), "key").when(whole & (F.length(literal) >= GRAM), "gram").when(whole & (literal == ""), "shape").otherwise("rest")
    )
    told = one.withColumns({"_kind": kind, "_key": F.when(kind == "key", F.concat(place, F.lit(BETWEEN), last)).when(kind == "gram", F.substring(literal, 1, GRAM)).otherwise("")})
    return told.drop("_x", "_s").distinct()


def _file_keys(path: Column) -> Column:
    """All keys that a glob could ask for a file by."""
    parts, base = F.split(path, "/"), P.basename(path)
    inner = F.slice(parts, 1, F.size(parts) - 1)
    places = F.concat(F.array(F.lit("")), F.transform(F.array_distinct(inner), lambda d: F.concat(F.lit("s:"), d)), F.transform(P.proper_ancestors(path), lambda d: F.concat(F.lit("p:"), d)))
    ending = F.regexp_extract(base, r"\.([^.]+)$", 1)
    lasts = F.concat(F.array(F.lit(""), F.concat(F.lit("n:"), base)), F.when(ending != "", F.array(F.concat(F.lit("e:"), ending))).otherwise(F.array().cast("array<string>")))
    every = F.flatten(F.transform(places, lambda p: F.transform(lasts, lambda t: F.concat(p, F.lit(BETWEEN), t))))
    return F.filter(every, lambda k: k != BETWEEN)


def matches(globs: DataFrame, files: DataFrame, scope: list[str]) -> DataFrame:
    """scope, glob, path of all files (scope, path) that globs (scope, glob) of the same scope match, once each.

    Globs are matched with whole paths. Nulls match nothing; empty tables give empty results; other columns are not read.
    """
    wanted = settled(keyed(globs.select(*scope, "glob").filter("glob is not null").distinct()).withColumn("_pattern", P.glob_regex(F.col("glob"))), "globs")
    kinds = {r["_kind"] for r in wanted.select("_kind").distinct().collect()}  # of four
    every = files.select(*scope, "path").filter("path is not null").distinct()
    fits = F.rlike(F.col("path"), F.col("_pattern"))

    def of(kind: str) -> DataFrame:
        return wanted.filter(F.col("_kind") == kind).drop("_kind")

    def by_key() -> DataFrame:
        return of("key").join(every.withColumn("_key", F.explode(_file_keys(F.col("path")))), [*scope, "_key"]).filter(fits)

    def some(kind: str) -> DataFrame:
        return every.join(of(kind).select(*scope).distinct(), scope, "left_semi")

    def by_gram() -> DataFrame:
        n = F.length("path") - GRAM + 1
        grams = F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr("path", i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))
        return of("gram").join(some("gram").withColumn("_key", F.explode(grams)), [*scope, "_key"]).filter(fits)

    def by_shape() -> DataFrame:
        # what has no literal can't tell names of one length apart
        shaped = some("shape").withColumn("_shape", F.regexp_replace("path", "[^/]", "x"))
        shapes = of("shape").join(shaped.select(*scope, "_shape").distinct(), scope).filter(F.rlike(F.col("_shape"), F.col("_pattern"))).select(*scope, "glob", "_shape")
        return shapes.join(shaped, [*scope, "_shape"])

    def by_all() -> DataFrame:
        return of("rest").join(some("rest"), scope).filter(fits)

    ways = {"key": by_key, "gram": by_gram, "shape": by_shape, "rest": by_all}
    found = [ways[k]().select(*scope, "glob", "path") for k in sorted(kinds)]
    return reduce(DataFrame.unionByName, found).distinct() if found else every.withColumn("glob", F.col("path")).limit(0).select(*scope, "glob", "path")
