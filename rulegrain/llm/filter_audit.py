"""Filter interaction audit: what each of five filters removes, at each place of each order of them.

Each document fails some of the filters; which ones is a mask of bits. Documents are counted by part and mask,
as all orders treat documents with one mask alike: a part has 32 cells at most, however many documents it has.
Cells are unpivoted against the steps of all orders into long form. There a running bit-or over the steps
before tells which filters came earlier, so conditional sums give each step's figures, and totals over each
filter's rows give its share over all orders.

Everything is expressions of Spark. Texts are compared by their SHA-256; only digests and masks are shuffled.
"""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The filters that the operator's contract states.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
SIGNS = "[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A filter's bit in a mask.
BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}
GAPS = r"[\x20\x09-\x0D]+"

COUNTS = ("n", "good", "toxic")


def failures_of_text(text: Column) -> Column:
    """The mask of a text without null, as far as the text alone decides it (all but E)."""
    words = F.array_remove(F.split(text, GAPS), "")
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))

    def told(letter: str, fails: Column) -> Column:
        return F.when(fails, BIT[letter]).otherwise(0)

    # words once for each row: they are counted in a function of the array
    by_words = F.transform(F.array(words), lambda w: told("A", F.size(w) < LEAST_WORDS) + told("B", 100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w)))[0]
    return by_words + told("C", 100 * upper > MOST_UPPER * F.length(text)) + told("D", text.rlike(SIGNS))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and how many documents they have: n, good, toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id", "part", F.when(F.col("doc_id").isNotNull(), F.unhex(F.sha2("text", 256))).alias("same"), failures_of_text(F.col("text")).alias("mask")
    )
    # equal rows are one from here on, and so are all of a mask that have no doc_id: they are no copies, and have no label
    rows = slim.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n"))
    told = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    marked = rows.filter("doc_id is not null").join(told.filter("good or toxic"), "doc_id", "left").na.fill(False, ["good", "toxic"])
    # of each text, by part and label, all rows and those of the smallest doc_id; then the smallest one of all
    texts = marked.groupBy("same", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    first = F.when(F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("same")), F.col("first.n")).otherwise(0)
    split = texts.withColumn("_first", first).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("_first").alias("n")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), (F.col("n") - F.col("_first")).alias("n")))).alias("c"))
    known = split.select("part", "c.mask", "c.n", "good", "toxic").filter("n > 0")
    bare = rows.filter("doc_id is null").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    n = F.col("n")
    return known.unionByName(bare).groupBy("part", "mask").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def steps(counted: DataFrame) -> DataFrame:
    """counted against all steps of all orders: filter_order, step, letter, bit."""
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    placed = counted.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letters = placed.withColumn("letter", F.substr("filter_order", "step", F.lit(1)))
    return letters.withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', letter) - 1)"))


def audit(counted: DataFrame) -> DataFrame:
    """The metrics of cells(), for each part, order and step."""
    long = steps(counted.select("part", "mask", *COUNTS))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    seen = long.withColumn("earlier", F.col("mask").bitwiseAND(F.coalesce(F.expr("bit_or(bit)").over(before), F.lit(0))) != 0)
    fails, passed = F.col("mask").bitwiseAND(F.col("bit")) != 0, ~F.col("earlier")

    def total(name: str, of: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long").alias(name)

    metrics = seen.groupBy("part", "filter_order", "step", "letter").agg(
        total("kept", "n", passed & ~fails), total("removed", "n", passed & fails), total("redundant", "n", F.col("earlier") & fails), total("unique_fails", "n", F.col("mask") == F.col("bit")),
        total("good_lost", "good", passed & fails), total("toxic_lost", "toxic", passed & fails),
    )
    return metrics.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Nulls: a null text counts as empty, a null source as the part of the empty string; a row with a null doc_id
    counts, but is no copy, makes none, and has no label. Rows of one doc_id don't make each other copies, so
    repeated rows count as often as they are there. Of several labels of one doc_id any that says so makes it
    good, or toxic; labels of unknown or null doc_ids and null marks say nothing. An empty table of documents
    has no parts, so its result is empty; an empty table of labels is one without marks. Other columns are not
    read. Texts are taken whole.
    """
    return audit(cells(docs, labels))


def brute(docs: pd.DataFrame, labels: pd.DataFrame) -> dict[tuple[str, str, int], tuple[int, ...]]:
    """The same, document by document and order by order, for tests."""
    texts = [t or "" for t in docs.text]
    ids = [None if d is None or d != d else int(d) for d in docs.doc_id]
    first: dict[str, int] = {}
    for d, t in zip(ids, texts, strict=True):
        if d is not None:
            first[t] = min(d, first.get(t, d))
    marks = {c: {int(d) for d, x in zip(labels.doc_id, labels[c], strict=True) if d == d and d is not None and x == 1} for c in ("quality", "toxic")}
    rows = []
    for d, t, s in zip(ids, texts, docs.source, strict=True):
        ws = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = {
            "A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and first[t] < d,
        }
        rows.append((s or "", fails, d in marks["quality"], d in marks["toxic"]))
    out: dict[tuple[str, str, int], list[int]] = {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations(FILTERS)):
            left = [r for r in rows if r[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if r[1][letter]]
                failing = [r for r in rows if r[0] == part and r[1][letter]]
                only = [r for r in failing if sum(r[1].values()) == 1]
                left = [r for r in left if not r[1][letter]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), len(only), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for letter in FILTERS:
            keys = [k for k in out if k[0] == part and k[1][k[2] - 1] == letter]
            whole = sum(out[k][1] for k in keys)
            for k in keys:
                out[k].append(whole)
    return {k: tuple(v) for k, v in out.items()}


# The same for each document, for DuckDB.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM w GROUP BY 1),
d AS (
  SELECT part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * len(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 5 * len(w.text), regexp_matches(w.text, '[#$%&*|]'), coalesce(first < doc_id, false)] AS f,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic
  FROM w LEFT JOIN firsts ON w.text = firsts.text
),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
steps AS (SELECT o, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, unnest(range(1, 6))::INT AS step FROM orders),
long AS (SELECT part, filter_order, step, o[step] AS letter, good, toxic, f, f[o[step]] AS fails, list_contains(list_transform(o[1:step - 1], lambda x: f[x]), true) AS earlier FROM d, steps),
metrics AS (
  SELECT part, filter_order, step, letter, count(*) FILTER (NOT earlier AND NOT fails) AS kept, count(*) FILTER (NOT earlier AND fails) AS removed, count(*) FILTER (earlier AND fails) AS redundant,
    count(*) FILTER (fails AND len(list_filter(f, lambda x: x)) = 1) AS unique_fails, count(*) FILTER (NOT earlier AND fails AND good) AS good_lost, count(*) FILTER (NOT earlier AND fails AND toxic) AS toxic_lost
  FROM long GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM metrics
"""
