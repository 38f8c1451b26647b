"""Ranks over whole tables. Rows are sorted by ranges of the order, each range in a task of its own, and each range begins
at the sum of what lies in the ranges before it. No task holds more than a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.stores.lineage import kept

#: Bits of `monotonically_increasing_id` that number the rows of a partition; those above number the partition.
PLACE_BITS = 33


def in_ranges(rows: DataFrame, *order: str | Column) -> DataFrame:
    """`rows` sorted by ranges, with the number of the range, `_range`, and the place in it from 0, `_at`. Computed once,
    as ranges are drawn from a sample and must not move."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    return kept(sorted_.withColumns({"_range": F.shiftright("_m", PLACE_BITS), "_at": F.col("_m").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("_m"))


def before(sums: DataFrame, value: str, *by: str) -> DataFrame:
    """`by..., _range, _start`: of a frame with a row for each group and range, the sum of `value` in earlier ranges."""
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    return sums.select(*by, "_range", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("_start"))


def placed(rows: DataFrame, *order: str | Column, by: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """`rows` with their place in the order, 1, 2, 3 and so on, among all rows or those of their group. Rows that tie in
    all of `order` come in any order, and in one task: end the order with what tells rows apart."""
    ranged = in_ranges(rows, *by, *order)
    stretches = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = before(stretches, "_n", *by).join(stretches.select(*by, "_range", "_first"), [*by, "_range"])
    if not by:
        starts = F.broadcast(starts)  # a row for each range
    return ranged.join(starts, [*by, "_range"]).withColumn(name, F.col("_start") + F.col("_at") - F.col("_first") + 1).drop("_range", "_at", "_start", "_first")


def average_ranks(rows: DataFrame, value: str, *by: str, name: str = "rank") -> DataFrame:
    """`by..., value, name`: the rank from 1 of each distinct value among the rows of its group, the mean of their places
    for equal ones. Equal values are counted before they are sorted, so one that many rows share is one row here."""
    counts = in_ranges(rows.groupBy(*by, value).agg(F.count("*").alias("_n")), *by, value)
    inside = W.partitionBy("_range", *by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)  # of one range
    own = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    starts = before(counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_n")), "_n", *by)
    return own.join(starts, [*by, "_range"]).select(*by, value, (F.col("_start") + F.col("_inside") + (F.col("_n") + 1) / 2).alias(name))
