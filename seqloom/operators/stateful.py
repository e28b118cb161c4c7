"""Stateful stream operators in batch form: dedupe, monotone gate, count batches, merges, replay, schedules and routes.

The model of acknowledgement is: rows are delivered in order of sequence, each settled before the next, with the outcome a function of the row.
The closed forms below hold in that model. Rows with null sequence are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.ids import event_key_of
from seqloom.operators.ordering import greatest_before, numbered

# ---- de-duplication ----


def against_store(rows: DataFrame, store: DataFrame, *, id_column: str = "id", stored: str = "event_id") -> DataFrame:
    """Rows whose event id is not in the store of processed ids. Ids are compared as UUIDs; a null id is in no store."""
    done = store.select(event_key_of(F.col(stored)).alias("_e")).where(F.col("_e").isNotNull()).distinct()
    return rows.withColumn("_e", event_key_of(F.col(id_column))).join(done, "_e", "left_anti").drop("_e")


# ---- monotone watermark gate ----


def monotone_gate(rows: DataFrame, *, keys: Sequence[str] = (), initial: DataFrame | None = None) -> DataFrame:
    """Rows whose timestamp is after the watermark of their key, which is the greatest timestamp passed so far.

    ``initial`` gives (keys, watermark) loaded at the start. The rows that pass are those after every earlier one of the key. Null timestamps never pass.
    """
    rows = rows.where(F.col("timestamp").isNotNull() & F.col("sequence").isNotNull())
    met = greatest_before(rows, "sequence", "timestamp", keys=tuple(keys), name="_mark")
    if initial is not None:
        met = met.join(initial.withColumnRenamed("watermark", "_stored"), list(keys), "left").withColumn("_mark", F.greatest("_mark", "_stored")).drop("_stored")
    return met.where(F.col("_mark").isNull() | (F.col("timestamp") > F.col("_mark"))).drop("_mark")


# ---- batches by count ----


def batched(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with batch number and index in the batch; the last batch may be short."""
    if size < 1:
        raise ValueError("a batch has at least one row")
    placed = numbered(rows.where(F.col("sequence").isNotNull()), "sequence")
    at = F.col("rn") - 1
    return placed.withColumn("batch", F.floor(at / F.lit(size)).cast("bigint")).withColumn("idx", (at % size).cast("int")).drop("rn")


def settle_subset(batches: DataFrame, size: int, indexes: Sequence[int]) -> DataFrame:
    """Members of each batch with ``settled`` for the indexes given; an index outside the batch size is an error."""
    if any(not 0 <= i < size for i in indexes):
        raise ValueError(f"an index is outside a batch of {size}")
    return batches.withColumn("settled", F.col("idx").isin(list(indexes)) if indexes else F.lit(False))


def batch_cursors(batches: DataFrame) -> DataFrame:
    """(batch, cursor_id, cursor_order): the id of the first member and the order of the last."""
    return batches.groupBy("batch").agg(F.min_by("id", "idx").alias("cursor_id"), F.max_by("sequence", "idx").alias("cursor_order"))


# ---- merges ----


def merged(left: DataFrame, right: DataFrame, weights: tuple[int, int] | None, *, order: str = "sequence") -> DataFrame:
    """Two ready streams merged: ``weights`` rows of the left, then of the right, and so on; None takes the left while it has rows.

    Adds ``side`` and ``position``. A row's position is its place in its stream plus the rows of the other side that come before it; an empty side
    yields to the other. Fair merging is (1, 1).
    """
    left, right = left.where(F.col(order).isNotNull()), right.where(F.col(order).isNotNull())
    a, b = numbered(left, order, name="_i"), numbered(right, order, name="_i")
    n_left, n_right = F.lit(left.count()), F.lit(right.count())
    both = a.withColumn("side", F.lit("left")).unionByName(b.withColumn("side", F.lit("right")))
    i = F.col("_i") - 1
    if weights is None:
        ahead = F.when(F.col("side") == "left", F.lit(0)).otherwise(n_left)
    else:
        wl, wr = weights
        if wl < 1 or wr < 1:
            raise ValueError("weights are positive")
        of_right = F.least(n_right, F.floor(i / F.lit(wl)) * wr)
        of_left = F.least(n_left, (F.floor(i / F.lit(wr)) + 1) * wl)
        ahead = F.when(F.col("side") == "left", of_right).otherwise(of_left)
    return both.withColumn("position", (F.col("_i") + ahead).cast("bigint")).drop("_i")


def merge_cursor(side: Column, cursor_id: Column) -> Column:
    """Cursor id of a branch, with the branch's name in front."""
    return F.concat(side, F.lit(":"), cursor_id)


def replay_then_live(history: DataFrame, live: DataFrame, *, dedupe: bool = True) -> DataFrame:
    """All of history, then live rows, with ``phase``; with ``dedupe`` live rows whose event is in history are skipped (and acked)."""
    if dedupe:
        live = against_store(live, history, stored="id")
    return history.withColumn("phase", F.lit("replay")).unionByName(live.withColumn("phase", F.lit("live")))


# ---- schedules, deadlines and outcomes ----


def release_times(rows: DataFrame, per_second: int) -> DataFrame:
    """``rows`` with ``release_us``: microseconds after the start when a rate limit lets the row pass."""
    if per_second < 1:
        raise ValueError("a rate is positive")
    placed = numbered(rows.where(F.col("sequence").isNotNull()), "sequence")
    return placed.withColumn("release_us", F.floor((F.col("rn") - 1) * 1_000_000 / F.lit(per_second)).cast("bigint")).drop("rn")


def expired(deliveries: DataFrame, timeout: str) -> DataFrame:
    """Deliveries (delivered_at, acked_at) with ``expired``: not settled, or later than the timeout."""
    late = F.col("acked_at") > F.col("delivered_at") + F.expr(f"interval {timeout}")
    return deliveries.withColumn("expired", F.coalesce(late, F.lit(True)))


def routed(rows: DataFrame, acked: Column, route_ok: Column, *, ack_after_route: bool = False, require_route: bool = True) -> DataFrame:
    """``rows`` with route and disposition of their outcome.

    The route is that of acked or of nacked rows. An acked row's disposition is ``acked``. A nacked row's is ``nacked``, or ``acked`` where the policy is to ack once it
    is routed. Where routing fails and is required the row is nacked as ``route_failed``; where it is best effort the failure changes nothing.
    """
    usual = F.when(acked | F.lit(ack_after_route), "acked").otherwise("nacked")
    disposition = F.when(~route_ok, F.lit("route_failed")).otherwise(usual) if require_route else usual
    return rows.withColumn("route", F.when(acked, "acked").otherwise("nacked")).withColumn("disposition", disposition)


def settled_once(settles: DataFrame, keys: Sequence[str], order: str, outcome: str) -> DataFrame:
    """(keys, outcome): the first settlement wins; of several at one time the least outcome."""
    return settles.groupBy(*keys).agg(F.min(F.struct(order, outcome)).alias("s")).select(*keys, F.col(f"s.{outcome}").alias(outcome))
