"""Connected components of a links table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, join_hot, table


def components(links: DataFrame) -> DataFrame:
    """node, root of links (a, b): root is the component's smallest node. Nodes without a link aren't told.

    Alternates large-star and small-star steps: each node's larger neighbours, then its smaller ones, are
    hung on its smallest neighbour. It ends when no link changes, after about log of the longest path steps.
    Nulls and links of a node to itself are left out; repeated links count once.
    """
    now = table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("_rows"))
        large = join_hot(both.filter("b > a"), least, "a", 2 * mark[0], "b").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_rows"))
        hung = join_hot(large, low, "a", 2 * mark[0], "b")
        small = hung.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = table(small, "links")
        drop_table(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
