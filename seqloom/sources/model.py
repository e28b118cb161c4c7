"""Schemas of the log and its state tables, reasons of refusal, and what each kind of source can do."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

LOG = (
    "sequence bigint, id string, organization string, namespace string, topic string, event_key string, payload string, content_type string, metadata map<string,string>, timestamp timestamp_ntz, version bigint, "
    "parent_id string, correlation_id string, causation_id string, partition_key string, partition_hash bigint, partition_id bigint, partition_count bigint, partition_strategy string"
)

TABLES = {
    "event_log": LOG,
    "offsets": "consumer_group_id string, stream_id string, cursor_id string, cursor string, cursor_order binary",
    "dedupe": "event_id string, processed_at timestamp_ntz",
    "watermarks": "key string, ts timestamp_ntz, updated_at timestamp_ntz",
    "buffer": "id bigint, event string, cursor string, pushed_at timestamp_ntz",
    "claim_buffer": "id bigint, event string, claimed_by string, claimed_until timestamp_ntz, attempts int, created_at timestamp_ntz",
    "multiplexer_completions": "event_id string, subscriber_id string, completed_at timestamp_ntz",
    "subscriber_work": "id bigint, subscriber_id string, event string, claimed_until timestamp_ntz, attempts int",
    "consumers": "consumer_group_id string, stream_id string, owner_id string, lease_until timestamp_ntz",
    "partitions": "consumer_group_id string, stream_id string, partition_id bigint, partition_count bigint, owner_id string, lease_until timestamp_ntz, checkpoint_sequence bigint, generation bigint",
}

NACK_REASONS = ["handler_error", "handler_timeout", "processing_rejected", "delivery_expired", "route_failed", "unknown"]
"""Reasons a delivery is refused for (fixed values)."""

RELATION = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}(?:\.[A-Za-z_][A-Za-z0-9_]{0,62})?")


def create_table_sql(name: str, relation: str | None = None) -> str:
    """``create table if not exists`` of a table under a relation name, with an optional schema in front."""
    relation = relation or name
    if not RELATION.fullmatch(relation):
        raise ValueError(f"{relation} is no name of a relation")
    quoted = ".".join(f"`{part}`" for part in relation.split("."))
    return f"create table if not exists {quoted} ({TABLES[name].replace('timestamp timestamp_ntz', '`timestamp` timestamp_ntz')}) using parquet"


def collected(spark: SparkSession, events: list[dict]) -> DataFrame:
    """Events gathered in memory as log rows; columns not given are null."""
    names = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", LOG).split(",")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in events], LOG)


@dataclass(frozen=True)
class Capabilities:
    """What a source can do."""

    cursor: bool = True
    start_after: bool = True
    timestamp_start: bool = True
    redelivery: bool = True
    checkpoints: bool = True
    partitions: bool = True
    total_order: bool = True


SOURCES = {
    "log": Capabilities(),
    "file_stream": Capabilities(start_after=False, timestamp_start=False, total_order=False),
    "kafka": Capabilities(total_order=False),
    "queue": Capabilities(cursor=False, start_after=False, timestamp_start=False, checkpoints=False, partitions=False, total_order=False),
    "memory": Capabilities(cursor=False, start_after=False, timestamp_start=False, redelivery=False, checkpoints=False, partitions=False),
}


@dataclass(frozen=True)
class Duplex:
    """One writer with one reader."""

    write: object
    read: object
