"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and queued up to three times over. A document's virtual
finish time is its source's cumulative size divided by the source's target, so sources advance in step with
their targets. All entries are put in order of finish time, and the mix ends where the budget is reached.

Running totals never gather a source, or everything, in one task: rows are range-sorted (documents by source
and hash, entries by finish time) into ranges of bounded size, ranges are summed first, and only the totals of
ranges and the rows of a single range are ever put in order together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, ready, table

#: Seed of the shuffle.
SEED = 7
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A document is taken this many times at most.
EPOCHS = 3
#: Rows for which there is a range, and ranges at most.
RANGE_ROWS, MOST_RANGES = 10_000, 20_000


def ranges(df: DataFrame, n: int, *order: str) -> DataFrame:
    """df, of n rows, range-sorted, with the number of each row's range: written, as ranges are cut by a sample."""
    parts = min(MOST_RANGES, max(12, -(-n // RANGE_ROWS)))
    return table(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "ranges")


def targets(sizes: DataFrame) -> DataFrame:
    """source_key, source_size, target of sizes (source, source_key, source_size): weights' shares of the whole, none above EPOCHS times its size.

    Sources are in order of the smallest share that fills them, so those that stop at their limit come
    first, and what is left is shared among the rest: the level at which the first one isn't above.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    # rows here are sources, not documents
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(in_order) - 1) % len(WEIGHTS) + 1).cast("int"))
    by_limit = Window.orderBy("limit_share", "source_key")
    before, rest, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    limit = (F.lit(EPOCHS) * F.col("source_size")).cast("double")
    return (
        sizes.withColumn("weight", weights)
        .withColumn("limit_share", limit / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("share", (F.col("total") - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("level", F.max(F.when(F.col("share") <= F.col("limit_share"), F.col("share"))).over(everything))
        .select("source_key", "source_size", F.when(F.col("share") > F.col("limit_share"), limit).otherwise(F.col("level") * F.col("weight")).alias("target"))
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, row: str | None = None) -> DataFrame:
    """key, size, source_size, target, taken and source_key for each row of docs.

    size is the text's number of words; taken is the words that the mix takes, a multiple of size. Nulls: a
    null text has size 0 and is never taken; null sources are one source, after all others; null keys are
    shuffled like one key. Ties in the shuffle go by size, then by a hash of the text; repeated rows are queued
    one by one, and which of equal rows is taken can't be told apart, except by the column row, which is passed
    on. Other columns are not read. An empty table gives an empty result. If all sizes are 0 nothing is taken.
    """
    ready(docs.sparkSession)
    source_key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("z"))
    shuffled = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    rows = table(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), source_key.alias("source_key"), shuffled.alias("h"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("id"), *([F.col(row).alias("row")] if row else []),
        ),
        "mix",
    )
    n = rows.count()
    shuffle = ["h", "size", "tie", "id"]
    by_range = ranges(rows, n, "source_key", *shuffle)
    sums = by_range.groupBy("source_key", "range").agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
    goals = targets(sums.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size")))
    up_to = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # ranges, not documents
    starts = sums.select("source_key", "range", F.coalesce(F.sum("range_size").over(up_to), F.lit(0)).alias("before")).join(goals, "source_key")
    inside = Window.partitionBy("source_key", "range").orderBy(*shuffle).rowsBetween(Window.unboundedPreceding, 0)
    queued = table(by_range.join(starts, ["source_key", "range"]).withColumn("total", F.col("before") + F.sum("size").over(inside)).drop("range", "before", "source", *(x for x in shuffle if x != "size")), "queue")

    finishes = [finish(e) for e in range(EPOCHS)]
    entries = queued.filter("size > 0").select("source_key", "size", F.explode(F.array(*finishes)).alias("finish")).filter("finish is not null")
    in_turn = ranges(entries, EPOCHS * n, "finish", "source_key")
    running = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # ranges, not entries
    steps = in_turn.groupBy("range").agg(F.sum("size").alias("words"))
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    over = steps.select("range", "words", F.sum("words").over(running).alias("reached")).filter(F.col("reached") > budget).orderBy("range").first()
    end = None
    if over is not None:  # the mix ends in this range, at the last entry that fits
        left = budget - (over["reached"] - over["words"])
        own = Window.orderBy("finish", "source_key").rowsBetween(Window.unboundedPreceding, 0)
        order = F.struct("finish", "source_key")
        cut = in_turn.filter(F.col("range") == over["range"]).withColumn("reached", F.sum("size").over(own))
        end = cut.agg(F.min(F.when(F.col("reached") > left, order)).alias("e")).select("e.*").first()

    def taken(f: Column) -> Column:
        """Whether an entry comes before the first one that doesn't fit."""
        return F.lit(True) if end is None else (f < end["finish"]) | ((f == end["finish"]) & (F.col("source_key") < end["source_key"]))

    times = sum(F.when(taken(f), 1).otherwise(0) for f in finishes)
    return queued.select(F.col("key").alias(key), "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * times).otherwise(0).cast("long").alias("taken"), "source_key", *([F.col("row").alias(row)] if row else []))


def finish(epoch: int) -> Column:
    """Virtual finish time of a document's entry in an epoch."""
    return F.when(F.col("target") > 0, (F.lit(epoch) * F.col("source_size") + F.col("total")) / F.col("target"))


# The same by plain windows, for DuckDB.
SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce('s' || source, 'z') AS source_key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':7') AS h
  FROM documents
), sizes AS (
  SELECT source_key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY 1
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes
), limits AS (
  SELECT *, (3 * source_size)::DOUBLE / weight AS limit_share, (SELECT sum(size) FROM rows_)::DOUBLE AS total FROM weighed
), shares AS (
  SELECT *, (total - coalesce(sum((3 * source_size)::DOUBLE) OVER (ORDER BY limit_share, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY limit_share, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS share
  FROM limits
), goals AS (
  SELECT source_key, source_size, CASE WHEN share > limit_share THEN (3 * source_size)::DOUBLE
         ELSE (SELECT max(share) FROM shares WHERE share <= limit_share) * weight END AS target
  FROM shares
), queued AS (
  SELECT doc_id, h, source_key, size, source_size, target,
         sum(size) OVER (PARTITION BY source_key ORDER BY h, size ROWS UNBOUNDED PRECEDING)::BIGINT AS total
  FROM rows_ JOIN goals USING (source_key)
), entries AS (
  SELECT *, (epoch * source_size + total)::DOUBLE / target AS finish FROM queued, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND target > 0
), reached AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_key ROWS UNBOUNDED PRECEDING) AS words FROM entries
), won AS (
  SELECT source_key, h, size, total, sum(size)::BIGINT AS taken FROM reached WHERE words <= (SELECT sum(size) FROM rows_) GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(w.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN won w ON q.source_key = w.source_key AND q.h = w.h AND q.size = w.size AND q.total = w.total
"""
