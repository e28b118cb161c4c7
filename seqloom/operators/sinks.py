"""Sinks and writer wrappers as DataFrame steps, and the wire form of events.

Writing itself is Spark's; what is here decides which rows are written, in which form and in which groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.functions.envelope import envelope_error, is_object, namespace_of, rfc3339
from seqloom.functions.ids import event_key_of, is_blank, uuid_key
from seqloom.operators.filters import Filter, column, settled
from seqloom.operators.ordering import numbered
from seqloom.operators.stateful import against_store

WIRE_SCHEMA = (
    "id string, organization string, namespace string, topic string, key string, payload struct<content_type:string,data:string>, metadata map<string,string>, timestamp string, version bigint, parent_id string, correlation_id string, causation_id string"
)


def wire() -> Column:
    """An event as one JSON text with its 12 fields in order; nulls are written, metadata is in key order.

    Readable JSON payloads are embedded in canonical form, all other data is a string (binary data already is base64).
    """
    json = (F.col("content_type") == "application/json") & is_object(F.col("payload"))
    data = F.when(json, F.try_parse_json("payload")).otherwise(F.col("payload").cast("variant"))
    fields = [
        "id", "organization", "namespace", "topic", F.col("event_key").alias("key"), F.struct("content_type", data.alias("data")).alias("payload"),
        F.map_from_entries(F.array_sort(F.map_entries("metadata"))).alias("metadata"), rfc3339(F.col("timestamp")).alias("timestamp"), "version", "parent_id", "correlation_id", "causation_id",
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def unwire(texts: DataFrame, name: str = "value", *, strict: bool = False) -> DataFrame:
    """Events of wire texts with ``readable``; null, broken and incomplete texts and events that break a rule of the envelope are not readable (they are acked and skipped), or with ``strict`` end the read."""
    parsed = F.from_json(F.col(name), WIRE_SCHEMA, {"mode": "PERMISSIVE"})
    e = F.col("event")
    needed = [e[c].isNotNull() for c in ("metadata", "timestamp", "version")]
    valid = envelope_error(e["organization"], namespace_of(e["namespace"]), e["topic"], e["key"], e["payload"]["content_type"], e["metadata"]).isNull() & uuid_key(e["id"]).isNotNull()
    good = is_object(F.col(name)) & reduce(lambda a, b: a & b, needed, F.coalesce(valid, F.lit(False)))
    if strict:
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("serialization error: no event")).cast("boolean"))
    return texts.withColumn("event", parsed).withColumn("readable", good)


def appended(log: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Rows of ``new`` that are not in the log by event id, whole and once each (the first by ``order``), numbered on from the log's end.

    Ids are compared as UUIDs; rows without id or order are no events and are left out.
    """
    new = new.drop("sequence").where(~is_blank(F.col("id")) & F.col(order).isNotNull()) if order != "sequence" else new.where(~is_blank(F.col("id")) & F.col(order).isNotNull())
    first = new.groupBy(event_key_of(F.col("id")).alias("_event")).agg(F.min_by(F.struct(*new.columns), order).alias("_row")).select("_row.*")
    fresh = against_store(first, log, stored="id")
    end = log.agg(F.coalesce(F.max("sequence"), F.lit(0))).head()[0]
    return numbered(fresh, order).withColumn("sequence", (F.col("rn") + F.lit(end)).cast("bigint")).drop("rn")


def mapped(rows: DataFrame, columns: dict[str, Column], *, valid: Column | None = None) -> DataFrame:
    """``rows`` with columns replaced. With ``valid`` one invalid row fails the whole write before anything is written."""
    out = rows.withColumns(columns)
    if valid is None:
        return out
    checked = F.when(settled(valid), F.lit(True)).otherwise(F.raise_error(F.lit("an event is invalid")).cast("boolean"))
    return out.where(checked)


def flat_mapped(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """None, one or many rows for each: one per item of an array; null and empty arrays give none."""
    return rows.withColumn(name, F.explode(items))


def filtered(rows: DataFrame, only: Filter) -> DataFrame:
    return rows.where(settled(column(only)))


def fanned_out(rows: DataFrame, writers: Sequence[str]) -> DataFrame:
    """Every row for every writer (``writer``); at least one writer."""
    if not writers:
        raise ValueError("a fan-out has a writer")
    return rows.withColumn("writer", F.explode(F.array(*map(F.lit, writers))))


def commit_offsets(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, next_offset): the greatest offset plus one, as a broker wants it committed."""
    return rows.groupBy(*keys).agg((F.max("sequence") + 1).alias("next_offset"))


def write_with_retry(write: Callable[[], None], attempts: int = 3, base_ms: float = 100, multiplier: float = 2.0, most_ms: float = 30_000, sleep: Callable[[float], None] | None = None) -> int:
    """Run a write until it succeeds, waiting longer after each failure; returns the attempts made, raises the last error."""
    import time

    if attempts < 1 or multiplier < 1:
        raise ValueError("at least one attempt and a multiplier of at least 1")
    for n in range(1, attempts + 1):
        try:
            write()
            return n
        except Exception:
            if n == attempts:
                raise
            (sleep or time.sleep)(min(base_ms * multiplier ** (n - 1), most_ms) / 1000)
    raise AssertionError


def ack_batches(settles: DataFrame, keys: Sequence[str], us: str, size: int, tick_us: int) -> DataFrame:
    """``settles`` with ``tick`` and ``batch``: an ack buffer flushes what waits at every tick of the clock and whenever ``size`` wait. Keys (and acks and nacks,
    if told apart by one) have buffers of their own."""
    ticked = settles.where(F.col(us).isNotNull() & F.col("sequence").isNotNull()).withColumn("tick", F.floor(F.col(us) / F.lit(tick_us)).cast("bigint"))
    placed = ticked.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "tick").orderBy(us, "sequence")))
    return placed.withColumn("batch", F.floor((F.col("_n") - 1) / F.lit(size)).cast("bigint")).drop("_n")


def memory_sink(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Everything the stream has, in a table ``name`` in the driver's memory; for small results and tests."""
    return stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_with_timeout(spark: SparkSession, write: Callable[[], None], seconds: float) -> None:
    """Run a write; after ``seconds`` its jobs are cancelled and TimeoutError is raised. What it left is as after any failed write."""
    group, failed = f"write-{uuid.uuid4().hex}", []

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "write with a time limit", interruptOnCancel=True)
        try:
            write()
        except Exception as e:  # handed to the caller
            failed.append(e)

    thread = InheritableThread(target=run, session=spark)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        thread.join()
        raise TimeoutError(f"the write took more than {seconds} s")
    if failed:
        raise failed[0]
