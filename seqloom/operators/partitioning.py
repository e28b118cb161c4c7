"""Deterministic hash partitions: resolvers, stamping, selection, backfill and lanes.

Null keys get no partition. The count must be positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.fnv import STRATEGY, fnv1a64, unsigned_mod
from seqloom.operators.ordering import numbered

STAMPS = ["partition_key", "partition_hash", "partition_id", "partition_count", "partition_strategy"]


def by_column(name: str) -> Column:
    """Resolver: an envelope column (event_key, organization, namespace, topic)."""
    return F.col(name)


def by_metadata(field: str, *, strict: bool = False) -> Column:
    """Resolver: a metadata field; with ``strict`` a missing field is an error, else it gives no partition."""
    found = F.try_element_at("metadata", F.lit(field))
    return F.coalesce(found, F.raise_error(F.lit(f"metadata field {field} is missing"))) if strict else found


def composite(parts: Sequence[Column], separator: str = ":") -> Column:
    """Resolver: several parts joined; null if one is null or the result isn't 1 to 1024 bytes long."""
    joined = F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit(separator)] if i else []) + [p]])
    return F.when(F.octet_length(joined).between(1, 1024), joined)


def stamped(rows: DataFrame, key: Column, count: int, resolver: str = "event_key") -> DataFrame:
    """``rows`` with the five partition columns set from a resolver."""
    if count < 1:
        raise ValueError("a partition count is at least 1")
    keyed = rows.drop(*STAMPS).withColumn("partition_key", key)
    hashed = keyed.withColumn("partition_hash", fnv1a64(F.col("partition_key")))
    known = F.col("partition_key").isNotNull()
    return hashed.withColumns({
        "partition_id": unsigned_mod(F.col("partition_hash"), count),
        "partition_count": F.when(known, F.lit(count).cast("bigint")),
        "partition_strategy": F.when(known, F.lit(f"{resolver}:{STRATEGY}")),
    })


def decoded(rows: DataFrame) -> DataFrame:
    """Partition (id, count) of stored rows: both null stand for the synthetic (0, 1), one alone is an error."""
    one = F.col("partition_id").isNull() != F.col("partition_count").isNull()
    broken = F.raise_error(F.lit("a row has half a partition")).cast("bigint")
    put = lambda name, none: F.when(one, broken).otherwise(F.coalesce(F.col(name), F.lit(none)))
    return rows.withColumns({"partition_id": put("partition_id", 0), "partition_count": put("partition_count", 1)})


def backfilled(rows: DataFrame, key: Column, count: int, resolver: str = "event_key") -> DataFrame:
    """Rows without partition stamped, all others as they are; on its own result it changes nothing."""
    have = rows.where(F.col("partition_id").isNotNull())
    lack = stamped(rows.where(F.col("partition_id").isNull()), key, count, resolver)
    return have.unionByName(lack)


def backfill_report(rows: DataFrame, size: int) -> DataFrame:
    """One row (rows_updated, batches) of a backfill in batches of ``size``."""
    if size < 1:
        raise ValueError("a batch has at least one row")
    return rows.agg(F.count_if(F.col("partition_id").isNull()).alias("rows_updated")).withColumn("batches", F.ceil(F.col("rows_updated") / F.lit(size)).cast("bigint"))


def laned(rows: DataFrame, lane: Column) -> DataFrame:
    """``rows`` with lane and place within it: sequence order, one task for each run of lanes and block of sequences."""
    return numbered(rows.withColumn("lane", lane), "sequence", keys=("lane",), name="place")


def lane_of_partition(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` laned by their stored partition, which must be one of ``count``: rows of another count are an error, as an invalid cursor."""
    wrong = F.raise_error(F.lit(f"invalid cursor: a row is not of {count} partitions")).cast("bigint")
    same = F.coalesce(F.col("partition_count") == count, F.lit(False)) & F.col("partition_id").between(0, count - 1)
    return laned(rows, F.when(same, F.col("partition_id")).otherwise(wrong))


def jams(rows: DataFrame, lane: str, lanes: int, capacity: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, stalled_at, jammed): where intake stalls if nothing is served, which is the first row that finds its lane full, and whether all lanes are full then, which
    with nothing in flight ends the read with an error. Null where it never stalls."""
    placed = numbered(rows.where(F.col("sequence").isNotNull() & F.col(lane).isNotNull()), "sequence", keys=(*keys, lane), name="_place")
    edge = placed.where(F.col("_place").isin(capacity, capacity + 1)).groupBy(*keys, lane).agg(F.min("sequence").alias("_full"), F.max(F.when(F.col("_place") > capacity, F.col("sequence"))).alias("_over"))
    by = edge.groupBy(*keys).agg(F.min("_over").alias("stalled_at"), F.max("_full").alias("_last"), F.count("*").alias("_n"))
    return by.select(*keys, "stalled_at", F.coalesce((F.col("_n") == lanes) & (F.col("_last") < F.col("stalled_at")), F.lit(False)).alias("jammed"))


def in_lane_order(rows: DataFrame, lane: str, handle: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``handle`` over the rows of each lane in order of sequence, one after the other: a lane is in one task, as one row in flight demands.

    The lane column comes first. A task may hold several lanes, one behind the other; batches may span lanes.
    """
    others = [c for c in rows.columns if c != lane]
    return rows.select(lane, *others).repartition(lane).sortWithinPartitions(lane, "sequence").mapInArrow(handle, schema)


def round_robin(rows: DataFrame, lane: Column, lanes: int) -> DataFrame:
    """Order in which lanes are served in turn, lane 1 first and lane 0 last in each turn, with full buffers and instant acks.

    A row's position follows from the lanes' sizes: in every earlier turn each lane that is long enough served once, and in its own turn so did the
    lanes before it.
    """
    placed = laned(rows, lane)
    # as many numbers as there are lanes
    found = {r["lane"]: r["n"] for r in placed.groupBy("lane").agg(F.count("*").alias("n")).collect()}
    sizes = F.array(*(F.struct(F.lit((k - 1) % lanes).alias("turn"), F.lit(n).cast("bigint").alias("n")) for k, n in sorted(found.items()))) if found else F.array().cast("array<struct<turn:int,n:bigint>>")
    turn = F.pmod(F.col("lane") - 1, F.lit(lanes))
    earlier = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, s: a + F.least(s["n"], F.col("place") - 1))
    same = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, s: a + F.when((s["turn"] < turn) & (s["n"] >= F.col("place")), 1).otherwise(0))
    return placed.withColumn("position", earlier + same + 1)
