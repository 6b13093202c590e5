"""Source divergence audit: how far the sources of a language are apart, term by term, in exact whole numbers.

Terms are counted by language and source inside the map tasks, so words never travel one by one. Each term of
a language is a posting list: the sources that have it, with their scaled shares. Two ways give the sum over
all terms for each two sources, and both are added:

- Terms in many sources (heavy) are laid into dense numpy tiles, sources by terms. A tile has a bounded number
  of terms and of sources; tiles of different sources meet block by block.
- Terms in few sources (light) are taken as if no other source had them: then a source's share meets only the
  other's share of a missing term, so equal shares of a source are counted first. Where two sources share a
  light term, the pair's correction is added from its posting list; lists are short, so these pairs are few.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, table, trim

# Fixed values of the operator's contract.
LEAST_DOCUMENTS, SCALE, TOP_TERMS = 10, 1_000_000_000, 10
#: Bytes of terms as they are, with A-Z lower-cased; all others are gaps. Bytes beyond ASCII belong to terms.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

#: A map task tells what it counted whenever it holds this many entries; bytes of a text that are split at once.
HELD, SLICE = 400_000, 4 << 20
#: Sources of a tile's side, terms of a tile, terms of a task for light lists, terms for which there is one salt of the counted shares.
BLOCK, TILE_TERMS, LIST_TERMS, SALT_TERMS = 256, 1024, 1024, 8192
#: Lists longer than this are heavy in any case; array cells that are computed at once.
LONGEST_LIST, CELLS = 512, 1 << 20

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])
PAIRS = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.int64())])
PAIRS_DDL = "lang string, i int, j int, value bigint"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, a slice at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and LETTERS[text[end]] != 0x20:
            end += 1
        yield text[at:end].translate(LETTERS).split()
        at = end


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to occurrences and documents of each term by lang and source."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            k = len(n)
            columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())]
            yield from pa.Table.from_arrays(columns, schema=COUNTS).to_batches(max_chunksize=50_000)
        held.clear()

    for batch in batches:
        langs, sources, texts = (batch.column(i).to_pylist() for i in range(3))
        for lang, source, text in zip(langs, sources, texts, strict=True):
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for found in terms(text):
                n.update(found)
                seen.update(found)
            df.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from told()
    yield from told()
    trim()


def share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * vocabulary)), by long division in thousands, as the product may be beyond 64 bits."""
    whole = f"greatest({total} + 2 * vocabulary, 1)"  # without kept terms there is nothing to divide
    first = f"(({n} + 2) * 1000)"
    second = f"({first} % {whole} * 1000)"
    third = f"({second} % {whole} * 1000)"
    return F.expr(f"1 + {first} div {whole} * 1000000 + {second} div {whole} * 1000 + {third} div {whole}")


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are 10^9 + 1 at most, so squares fit."""
    d = (p - q).astype(np.int64)
    return ((d * d).view(np.uint64) // (p + q).astype(np.uint64)).astype(np.int64)


def _pairs(lang: str, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(np.minimum(i, j), pa.int32()), pa.array(np.maximum(i, j), pa.int32()), pa.array(value, pa.int64())], schema=PAIRS)


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy() for n in names]


def dense(tile: pa.Table) -> pa.Table:
    """Sums of one tile over its terms. tile: lang, bi, bj, idx, term, p; rows without a term give a source's share of missing terms."""
    lang, bi, bj = (tile.column(c)[0].as_py() for c in ("lang", "bi", "bj"))
    idx, p = _columns(tile, "idx", "p")
    coded = tile.column("term").combine_chunks().dictionary_encode()
    real = coded.is_valid().to_numpy(zero_copy_only=False)
    code = coded.indices.fill_null(0).to_numpy(zero_copy_only=False)
    sources, row = np.unique(idx, return_inverse=True)
    missing = np.zeros(len(sources), np.int64)
    missing[row[~real]] = p[~real]
    shares = np.repeat(missing[:, None], len(coded.dictionary), axis=1)
    shares[row[real], code[real]] = p[real]
    left, right = np.flatnonzero(sources // BLOCK == bi), np.flatnonzero(sources // BLOCK == bj)
    out_i, out_j, out_v = [], [], []
    step = max(1, CELLS // max(1, shares.shape[1]))
    for r in left.tolist() if shares.shape[1] else ():
        others = right[right > r]
        for at in range(0, len(others), step):
            o = others[at : at + step]
            out_v.append(apart(shares[r], shares[o]).sum(axis=1))
            out_i.append(np.full(len(o), sources[r]))
            out_j.append(sources[o])
    return _pairs(lang, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_i, out_j, out_v)))


def _combined(code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, value = code[order], value[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(value, first) if len(first) else value


def corrections(lists: pa.Table) -> pa.Table:
    """What posting lists of light terms add where two sources share a term. lists: lang, term, idx, p, z."""
    lang, width = lists.column("lang")[0].as_py(), 1 << 31
    term = lists.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    idx, p, z = _columns(lists, "idx", "p", "z")
    order = np.lexsort((idx, term))
    term, idx, p, z = term[order], idx[order].astype(np.int64), p[order], z[order]
    first = np.flatnonzero(np.diff(term, prepend=-1))
    until = np.repeat(np.append(first[1:], len(term)), np.diff(np.append(first, len(term))))
    partners = until - np.arange(len(term)) - 1  # those after each posting in its list
    done_code, done_value = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(partners)
    at = 0
    while at < len(term):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
        k = partners[at:stop]
        a = np.repeat(np.arange(at, stop), k)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        value = apart(p[a], p[b]) - apart(p[a], z[b]) - apart(z[a], p[b]) + apart(z[a], z[b])
        done_code, done_value = _combined(np.concatenate([done_code, idx[a] * width + idx[b]]), np.concatenate([done_value, value]))
        at = stop
    return _pairs(lang, done_code // width, done_code % width, done_value)


def one_sided(shares: pa.Table) -> pa.Table:
    """Light terms as if only one of two sources had each. shares: lang, idx, p, n, up, target.

    Rows of a target give its share of missing terms as p. Other rows: n terms have share p at a source. up is how
    many terms there are in all; they are counted once for each two sources, as missing in both.
    """
    lang = shares.column("lang")[0].as_py()
    idx, p, n, up = _columns(shares, "idx", "p", "n", "up")
    target = shares.column("target").to_numpy(zero_copy_only=False)
    to, z = idx[target], p[target]
    idx, p, n, up = idx[~target], p[~target], n[~target], up[~target]
    order = np.argsort(idx, kind="stable")
    idx, p, n, up = idx[order], p[order], n[order], up[order]
    first = np.flatnonzero(np.diff(idx, prepend=-1))
    sums = np.zeros((len(first), len(to)), np.int64)
    own = np.cumsum(np.diff(idx, prepend=-1) != 0) - 1
    step = max(1, CELLS // max(1, len(to)))
    for at in range(0, len(idx), step):
        rows = slice(at, at + step)
        far = apart(p[rows, None], z[None, :])
        times = n[rows, None] + np.where(to[None, :] > idx[rows, None], up[rows, None], 0)
        np.add.at(sums, own[rows], far * times)
    i, j = np.repeat(idx[first], len(to)), np.tile(to, len(first))
    other = i != j
    return _pairs(lang, i[other], j[other], sums.ravel()[other])


def postings(docs: DataFrame) -> DataFrame:
    """lang, term, source, n, k, n_lang, lead: kept terms by source; k sources have the term, n_lang is its count there, one row of each term leads."""
    parts = docs.mapInArrow(count, "lang string, source string, term string, n bigint, df bigint")
    # one exchange serves both the sums and the windows
    summed = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    of_term = summed.select("lang", "term", "source", "n", F.sum("df").over(term).alias("df"), F.count("*").over(term).alias("k"), F.sum("n").over(term).alias("n_lang"), (F.col("source") == F.min("source").over(term)).alias("lead"))
    return of_term.filter(F.col("df") >= LEAST_DOCUMENTS).drop("df")


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total, vocabulary, total_lang, sources, idx, z: every group, numbered within its language."""
    lang = Window.partitionBy("lang")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("vocabulary"), F.sum("n").alias("total_lang"))
    every = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    numbered = every.withColumn("sources", F.count("*").over(lang)).withColumn("idx", F.row_number().over(lang.orderBy("source")) - 1)
    return numbered.withColumn("z", share("0L", "total"))


def _with_blocks(df: DataFrame) -> DataFrame:
    """Rows of a source to each pair of blocks that its block is in: bi, bj."""
    own = F.floor(F.col("idx") / BLOCK).cast("int")
    other = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / BLOCK).cast("int"))))
    return other.withColumn("bi", F.least(own, "_o")).withColumn("bj", F.greatest(own, "_o")).drop("_o")


def _parts(size: int) -> Column:
    """One part for each size terms of the language."""
    return F.floor(F.col("vocabulary") / size).cast("int") + 1


def _part(key: str, size: int) -> Column:
    return F.pmod(F.xxhash64(key), _parts(size)).cast("int")


def _all_parts(size: int) -> Column:
    return F.explode(F.sequence(F.lit(0), _parts(size) - 1))


def pair_sums(told: DataFrame, every: DataFrame) -> DataFrame:
    """lang, i, j, value for each two groups of a language, by their numbers, i below j. told: postings with their group's columns, p and heavy."""
    heavy, light = told.filter("heavy"), told.filter("not heavy")
    cell = heavy.select("lang", _part("term", TILE_TERMS).alias("part"), "idx", "sources", "term", "p")
    blank = every.select("lang", _all_parts(TILE_TERMS).alias("part"), "idx", "sources", F.lit(None).cast("string").alias("term"), F.col("z").alias("p"))
    tiles = _with_blocks(cell.unionByName(blank)).select("lang", "part", "bi", "bj", "idx", "term", "p")
    shared = light.filter("k > 1").select("lang", _part("term", LIST_TERMS).alias("part"), "term", "idx", "p", "z")

    # equal shares of a source are counted; each target meets them, salt by salt
    of_lang = light.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("all_light"))
    of_source = light.groupBy("lang", "idx").agg(F.count("*").alias("own_light"))
    counted = light.groupBy("lang", "idx", "sources", "vocabulary", "p").agg(F.count("*").alias("n")).withColumn("up", F.lit(0).cast("long"))
    absent = every.join(of_lang, "lang", "left").join(of_source, ["lang", "idx"], "left").na.fill(0, ["all_light", "own_light"]).select("lang", "idx", "sources", "vocabulary", F.col("z").alias("p"), (-F.col("own_light")).alias("n"), F.col("all_light").alias("up"))
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / BLOCK).cast("int")))
    own = F.floor(F.col("idx") / BLOCK).cast("int")
    sides = counted.unionByName(absent).select("lang", _part("p", SALT_TERMS).alias("part"), own.alias("bi"), blocks.alias("bj"), "idx", "p", "n", "up", F.lit(False).alias("target"))
    none = F.lit(0).cast("long")
    targets = every.withColumn("part", _all_parts(SALT_TERMS)).select("lang", "part", blocks.alias("bi"), own.alias("bj"), "idx", F.col("z").alias("p"), none.alias("n"), none.alias("up"), F.lit(True).alias("target"))

    by_tile = tiles.groupBy("lang", "part", "bi", "bj").applyInArrow(dense, PAIRS_DDL)
    by_list = shared.groupBy("lang", "part").applyInArrow(corrections, PAIRS_DDL)
    by_share = sides.unionByName(targets).groupBy("lang", "part", "bi", "bj").applyInArrow(one_sided, PAIRS_DDL)
    return by_tile.unionByName(by_list).unionByName(by_share).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank for each group of rows with one lang and source.

    part `pair`: item is another source of the lang, value the summed distance over all kept terms. part
    `term`: the ten kept terms that stand out most from the whole lang. Nulls: a null text, lang or source counts
    as the empty string. Ties go to the smaller item in UTF-8. A document is a row, so repeated rows count as
    often as they are there. doc_id and other columns are not read. A group without terms has its pairs. An empty
    table gives an empty result; a lang with one source has no pairs. Texts are taken whole. Sums are exact in
    64 bits: counts may be up to 9 * 10^15. Two tables (postings, groups) stay in the shared folder, as the result reads them.
    """
    ready(docs.sparkSession)
    plain = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = table(postings(plain), "postings")
    every = table(groups(plain, kept), "groups")
    joined = kept.join(every, ["lang", "source"]).withColumn("p", share("n", "total"))
    told = joined.withColumn("heavy", (2 * F.col("k") >= F.col("sources")) | (F.col("k") > LONGEST_LIST))

    sums = pair_sums(told, every)
    both = sums.select("lang", "value", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("_p")).select("lang", "value", "_p.*")
    names = every.select("lang", "source", "idx")
    pairs = both.join(names.withColumnRenamed("idx", "i"), ["lang", "i"]).join(names.select("lang", F.col("source").alias("item"), F.col("idx").alias("j")), ["lang", "j"])

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    far = told.withColumn("q", share("n_lang", "total_lang")).filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    top = far.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= TOP_TERMS)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair")).select(*columns).unionByName(top.withColumn("part", F.lit("term")).select(*columns))


def brute(docs: pd.DataFrame) -> set[tuple[str, str, str, str, int, int]]:
    """The same, term by term, for tests."""
    rows = [(lang or "", source or "", text or "") for lang, source, text in zip(docs.lang, docs.source, docs.text, strict=True)]
    out = set()
    for lang in {r[0] for r in rows}:
        count_of: dict[str, Counter] = {r[1]: Counter() for r in rows if r[0] == lang}
        df: Counter = Counter()
        for _, source, text in (r for r in rows if r[0] == lang):
            low = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or c > "\x7f" else " " for c in text)
            found = [t for t in low.split(" ") if t]
            count_of[source].update(found)
            df.update(set(found))
        kept = [t for t in df if df[t] >= LEAST_DOCUMENTS]
        V = len(kept)
        shares = {}
        for name, c in [*count_of.items(), (None, sum(count_of.values(), Counter()))]:
            total = sum(c[t] for t in kept)
            shares[name] = {t: 1 + SCALE * (c[t] + 2) // (total + 2 * V) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // (p + q)
        for s in count_of:
            pairs = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in count_of if o != s]
            found = [(f(shares[s][t], shares[None][t]), t) for t in kept if count_of[s][t] and shares[s][t] > shares[None][t]]
            for part, items in (("pair", pairs), ("term", found)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, r) for r, (v, item) in enumerate(items, 1) if part == "pair" or r <= TOP_TERMS}
    return out


# The same over all terms of all pairs, for DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(term)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
full_counts AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM full_counts JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM full_counts GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM l JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
