"""Positions along an order, without putting all rows into one task.

Rows are cut into blocks of the order column's values; inside a block a window gives the position, and the blocks' totals, one row each,
give what comes before. Only the totals pass through one window: one row for each ``BLOCK`` values, so a log of 10 ** 12 rows has about 10 ** 7 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def block_of(order: str) -> Column:
    return F.floor(F.col(order) / F.lit(BLOCK))


def numbered(rows: DataFrame, order: str, *, keys: tuple[str, ...] = (), ties: tuple[str, ...] = (), name: str = "rn") -> DataFrame:
    """``rows`` with the row's number from 1 along ``order`` (a whole number, not null), per ``keys`` where given."""
    rows = rows.withColumn("_b", block_of(order))
    totals = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order, *ties)
    placed = rows.withColumn("_in_block", F.row_number().over(inside)).join(starts, [*keys, "_b"])
    return placed.withColumn(name, (F.col("_in_block") + F.col("_start")).cast("bigint")).drop("_b", "_in_block", "_start")


def greatest_before(rows: DataFrame, order: str, value: str, *, keys: tuple[str, ...] = (), name: str = "before") -> DataFrame:
    """``rows`` with the greatest ``value`` among earlier rows along ``order``, per ``keys``; null where there is none."""
    rows = rows.withColumn("_b", block_of(order))
    tops = rows.groupBy(*keys, "_b").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    entry = tops.select(*keys, "_b", F.max("_top").over(earlier).alias("_entry"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("_met", F.max(value).over(inside)).join(entry, [*keys, "_b"])
    return met.withColumn(name, F.greatest("_met", "_entry")).drop("_b", "_met", "_entry")
