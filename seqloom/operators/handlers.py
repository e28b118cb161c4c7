"""Handlers: outcomes, retries, dead letters, fan-out to subscribers and their work queue.

A handler is a function of the row, given as Columns: whether it succeeds, how long it takes, at which attempt it first succeeds. Null outcomes count as failures.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.envelope import backoff_ms, rfc3339
from seqloom.functions.ids import event_key_of, uuid7
from seqloom.operators.filters import Filter, column, settled
from seqloom.operators.sinks import wire


def handled(rows: DataFrame, ok: Column, *, only: Filter | None = None, duration_ms: Column | None = None, timeout_ms: int | None = None) -> DataFrame:
    """``rows`` with ``outcome``: ok, error or timeout. Rows that ``only`` leaves out succeed unhandled."""
    outcome = F.when(settled(ok), "ok").otherwise("error")
    if duration_ms is not None and timeout_ms is not None:
        outcome = F.when(settled(duration_ms > timeout_ms), "timeout").otherwise(outcome)
    if only is not None:
        outcome = F.when(settled(column(only)), outcome).otherwise("ok")
    return rows.withColumn("outcome", outcome)


def attempts(rows: DataFrame, succeeds_at: Column, most: int = 3, policy: Column | None = None) -> DataFrame:
    """One row per attempt: ``attempt``, its ``state`` (ok, retry, dead_letter or skip) and the delay after it.

    ``succeeds_at`` is the attempt that would succeed; null for never. ``policy`` tells what is done with a row's failure, by its kind: ``retry`` (the default, also for null)
    until the attempts are used up, ``dead_letter`` or ``skip`` at once. All ends but retry are acknowledged.
    """
    if most < 1:
        raise ValueError("at least one attempt")
    action = F.coalesce(policy, F.lit("retry")) if policy is not None else F.lit("retry")
    last = F.when(action == "retry", F.least(F.coalesce(succeeds_at, F.lit(most + 1)), F.lit(most))).otherwise(F.lit(1)).cast("int")
    each = rows.withColumn("_at", succeeds_at).withColumn("_do", action).select("*", F.explode(F.sequence(F.lit(1), last)).alias("attempt"))
    state = F.when(F.col("attempt") == F.col("_at"), "ok").when(F.col("_do") != "retry", F.col("_do")).when(F.col("attempt") >= most, "dead_letter").otherwise("retry")
    delay = F.when(state == "retry", backoff_ms(F.col("attempt")))
    return each.withColumn("state", state).withColumn("delay_ms", delay).drop("_at", "_do")


def decoded(rows: DataFrame, good: Column, disposition: str = "ack") -> DataFrame:
    """``rows`` with ``readable`` and ``settlement``: what a decoding reader does with a row it can't decode before it reports the error.

    ``surface`` leaves the row to the caller (null), ``ack`` drops it for good, ``nack`` gives it back. Readable rows are the handler's to settle (null).
    """
    if disposition not in ("surface", "ack", "nack"):
        raise ValueError(f"{disposition} is no disposition")
    readable = settled(good)
    kept = F.lit(None).cast("string") if disposition == "surface" else F.when(~readable, disposition)
    return rows.withColumn("readable", readable).withColumn("settlement", kept)


def final_state(rows: DataFrame, succeeds_at: Column, most: int = 3) -> DataFrame:
    """``rows`` with the number of attempts made and the final state (ok or dead_letter); both end in an acknowledgement."""
    good = settled(succeeds_at <= most)
    return rows.withColumn("attempts", F.when(good, succeeds_at).otherwise(F.lit(most)).cast("int")).withColumn("state", F.when(good, "ok").otherwise("dead_letter"))


def dead_letters(rows: DataFrame, handler: str, attempts: Column, error: Column, failed_at: Column) -> DataFrame:
    """Dead-letter events of failed rows: an id of their own, topic with ``.dead_letter`` behind, the original as parent, its correlation but not its causation, no
    metadata; the payload tells the original event in its wire form, handler, attempts, error and time. The id follows from the original, handler and attempt, so a
    repeated failure of one attempt is one dead letter."""
    payload = F.struct(F.parse_json(wire()).alias("original_event"), F.col("id").alias("original_event_id"), F.lit(handler).alias("handler_id"), attempts.alias("attempts"), error.alias("error"), rfc3339(failed_at).alias("failed_at"))
    return rows.select(
        uuid7(failed_at, F.col("id"), F.lit(handler), attempts).alias("id"), "organization", "namespace", F.concat("topic", F.lit(".dead_letter")).alias("topic"), "event_key", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"), F.lit("application/json").alias("content_type"),
        F.create_map().cast("map<string,string>").alias("metadata"), failed_at.alias("timestamp"), F.lit(1).cast("bigint").alias("version"), F.col("id").alias("parent_id"), "correlation_id", F.lit(None).cast("string").alias("causation_id"),
    )


@dataclass(frozen=True)
class Route:
    """A subscriber and the events it takes."""

    subscriber: str
    filter: Filter


def _checked(routes: Sequence[Route]) -> None:
    names = [r.subscriber for r in routes]
    if len(set(names)) != len(names):
        raise ValueError("a subscriber has one route")


def matching(routes: Sequence[Route]) -> Column:
    """Array of the subscribers whose route takes the row, in declaration order: a predicate each, no join."""
    _checked(routes)
    each = [F.when(settled(column(r.filter)), F.lit(r.subscriber)) for r in routes]
    return F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast("array<string>")


def multiplexed(rows: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """One row per event row and matching subscriber (``subscriber_id``)."""
    return rows.withColumn("subscriber_id", F.explode(matching(routes)))


def unmatched(rows: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """Rows that no route takes."""
    return rows.where(F.size(matching(routes)) == 0)


def unmatched_outcome(rows: DataFrame, routes: Sequence[Route], policy: str = "ack") -> DataFrame:
    """Rows that no route takes, with ``outcome``: acked, or with the policy ``error`` refused as handler_error."""
    if policy not in ("ack", "error"):
        raise ValueError(f"{policy} is no policy")
    return unmatched(rows, routes).withColumn("outcome", F.lit("ack" if policy == "ack" else "handler_error"))


def remaining(deliveries: DataFrame, completions: DataFrame) -> DataFrame:
    """Deliveries (id, subscriber_id) not yet completed; ids are compared as UUIDs."""
    done = completions.select(event_key_of(F.col("event_id")).alias("_e"), "subscriber_id").where("_e is not null and subscriber_id is not null").distinct()
    return deliveries.withColumn("_e", event_key_of(F.col("id"))).join(done, ["_e", "subscriber_id"], "left_anti").drop("_e")


def acknowledged(deliveries: DataFrame, ok: Column, keys: Sequence[str] = ("sequence",)) -> DataFrame:
    """(keys, n_subscribers, n_failed, acked): a source row is acked only if every matching subscriber succeeds; failures are all gathered."""
    by = deliveries.groupBy(*keys).agg(F.count("*").alias("n_subscribers"), F.count_if(~settled(ok)).alias("n_failed"))
    return by.withColumn("acked", F.col("n_failed") == 0)


def work_items(rows: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """Work queue entries (sequence, subscriber_id, event_key, claimed_until, attempts) of new events, unclaimed."""
    return multiplexed(rows, routes).select("sequence", "subscriber_id", "event_key", F.lit(None).cast("timestamp_ntz").alias("claimed_until"), F.lit(0).alias("attempts"))
