"""Exact ranks within groups of any size, in two passes instead of one window for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settled import settled


def with_ranks(rows: DataFrame, by: list[str], order: list[Column], rank: str = "rank", count: str = "count") -> DataFrame:
    """rows with each one's place (from 0) in its group, and the group's number of rows.

    Rows are dealt out in ranges of group and order, so a group may lie in many tasks; each task numbers its own,
    and the counts of the ranges before are added. order should tell a group's rows apart: rows that it doesn't
    come by the hash of their columns, and rows that are equal in all of these stay in one task. Nulls in by are
    one group. An empty table gives an empty result. rank and count must be new names.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    ends = [f"_order{i}" for i in range(len(order))]
    told = rows.select("*", *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *(o.alias(k) for o, k in zip(order, ends, strict=True)), F.xxhash64(*rows.columns).alias("_tie"))
    sort = [*keys, *ends, "_tie"]
    dealt = told.repartitionByRange(*sort).sortWithinPartitions(*sort)
    # numbers ascend within a task, in its order
    placed = settled(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}).drop(*ends, "_tie"), "ranked")
    ranges = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    # a row for each group and task that it lies in
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        *(F.col(k).alias(f"{k}_") for k in keys), F.col("_part").alias("_part_"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias(count)
    )
    on = [F.col("_part") == F.col("_part_"), *(F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys)]
    joined = placed.join(offsets, on)
    return joined.select(*rows.columns, (F.col("_before") + F.col("_place") - F.col("_first")).alias(rank), F.col(count))
