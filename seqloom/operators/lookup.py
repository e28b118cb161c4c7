"""Join on a key that a few values of may hold most rows of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 100_000
"""Rows above which a key is hot. At most (rows / HOT) keys are."""


def hot_limit(rows: int | None) -> int:
    """HOT, or so many rows that no more than 1,000 keys can be hot; that bounds what is broadcast."""
    return max(HOT, (rows or 0) // 1000)


def skew_safe_lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", *, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which holds a key at most once, on the column ``key``.

    Keys with more than ``hot_limit`` rows are found by a map-side combined count; their entries of the table, at most
    1,000, are broadcast, and their rows never shuffle. All other rows meet the table by a shuffle on the key, in
    which no key exceeds the limit. Null keys match nothing: ``inner`` drops them, ``left`` keeps them with nulls and
    spreads them over all tasks.
    """
    if total is None:
        total = rows.count()
    values = [c for c in table.columns if c != key]
    cold_only = total <= HOT
    present = rows.where(F.col(key).isNotNull())
    if cold_only:
        out = present.join(table, key, how)
    else:
        hot = present.groupBy(key).count().where(F.col("count") > hot_limit(total)).select(key, F.lit(True).alias("_hot"))
        tagged = present.join(F.broadcast(hot), key, "left")
        entries = F.broadcast(table.join(F.broadcast(hot.select(key)), key, "left_semi"))
        cold = tagged.where(F.col("_hot").isNull()).drop("_hot").join(table, key, how)
        warm = tagged.where(F.col("_hot")).drop("_hot").join(entries, key, how)
        out = cold.unionByName(warm)
    if how == "left":
        nulls = rows.where(F.col(key).isNull()).select(*rows.columns, *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in values))
        out = out.unionByName(nulls)
    return out
