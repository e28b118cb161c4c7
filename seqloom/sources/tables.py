"""Stored tables of the log and its state, read with column pruning left to the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.ids import event_key_of, is_blank

FIXED_WIDTH = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One stored table; a file or a directory of Parquet parts."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def first_rows(log: DataFrame, **values: Column) -> DataFrame:
    """The first row of each event: the row of lowest ``sequence`` among those with one id.

    Returns ``event`` (16 bytes), ``sequence`` and the columns given by name. Rows of equal sequence are the same
    row, so any of them stands for all; rows with a null sequence or without an id are no events.

    The aggregate combines on the map side, so that repeated deliveries of one id, however many, arrive
    at the shuffle as one row per input split; nothing gathers a group. Values of fixed width are kept in a hash
    table; a text or a struct among them makes the engine sort each split instead.
    """
    # the condition is on the text, because one on the key would have the key computed twice
    rows = log.where(~is_blank(F.col("id")) & F.col("sequence").isNotNull())
    rows = rows.select(event_key_of(F.col("id")).alias("event"), F.col("sequence").cast("bigint").alias("sequence"), *(c.alias(k) for k, c in values.items()))
    first = F.min("sequence").alias("sequence")
    if all(isinstance(rows.schema[k].dataType, FIXED_WIDTH) for k in values):
        return rows.groupBy("event").agg(first, *(F.min_by(k, "sequence").alias(k) for k in values))
    best = F.min_by(F.struct(*values), "sequence").alias("row")
    return rows.groupBy("event").agg(first, best).select("event", "sequence", "row.*")
