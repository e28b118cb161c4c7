"""Brokers: Kafka by Spark's own connector, queue services by an injected client.

Spark's Kafka connector is a separate jar; nothing here needs it until a stream is opened. Bodies are wire texts, see ``seqloom.operators.sinks.wire``.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from seqloom.operators.folds import batches
from seqloom.operators.positions import InvalidCursor, StartFrom, Subscription
from seqloom.operators.sinks import unwire, wire

MOST_ENTRIES, MOST_BYTES, MOST_WAIT_S = 10, 256 * 1024, 20


def kafka_options(servers: str, topic: str, start: StartFrom, partitions: int = 1) -> dict[str, str]:
    """Reader options of a start position: earliest, latest, a time (seek by timestamp) or an exclusive offset for every partition."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "failOnDataLoss": "true"}
    if start.kind in ("earliest", "latest"):
        return options | {"startingOffsets": start.kind}
    if start.kind == "timestamp":
        return options | {"startingTimestamp": str(start.value)}
    if start.kind == "after":
        return options | {"startingOffsets": json.dumps({topic: {str(p): int(start.value) + 1 for p in range(partitions)}})}
    raise InvalidCursor(start.kind)


def kafka_stream(spark: SparkSession, servers: str, topic: str, sub: Subscription, partitions: int = 1) -> DataFrame:
    """Events of a topic; bodies that are null or unreadable are skipped, their offsets advance."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topic, sub.start, partitions)).load()
    return readable(raw.select(F.col("value").cast("string").alias("value"), "partition", "offset"))


def readable(bodies: DataFrame) -> DataFrame:
    """Events of wire texts in column ``value``, poison left out."""
    return unwire(bodies).where("readable").select("event.*", *(c for c in bodies.columns if c != "value"))


def kafka_records(rows: DataFrame) -> DataFrame:
    """(key, value) as the Kafka sink wants it."""
    return rows.select(F.col("event_key").alias("key"), wire().alias("value"))


class QueueClient(Protocol):
    """What is needed of a queue service."""

    def receive(self, most: int, wait_s: int) -> list[tuple[str, str]]: ...

    def delete(self, handles: list[str]) -> list[str]: ...

    def release(self, handles: list[str]) -> list[str]: ...

    def send(self, bodies: list[str]) -> list[int]: ...


class QueueReader:
    """Polls a queue; poison is deleted and skipped, other messages are handed on with their handle.

    An empty poll is followed by the next one, and a failed one by another after ``pause_s``. ``limit`` messages, ``polls`` empty polls in a row (for ever without) or
    ``stop()`` end the stream.
    """

    def __init__(self, client: QueueClient, decode: Callable[[str], object], *, wait_s: int = MOST_WAIT_S, pause_s: float = 1.0, sleep: Callable[[float], None] = time.sleep):
        self.client, self.decode, self.wait_s, self.pause_s, self._sleep, self._stopped = client, decode, min(wait_s, MOST_WAIT_S), pause_s, sleep, False

    def stop(self) -> None:
        self._stopped = True

    def read(self, limit: int | None = None, polls: int | None = None) -> Iterator[tuple[str, object]]:
        given, empty = 0, 0
        while not self._stopped and (limit is None or given < limit) and (polls is None or empty < polls):
            try:
                messages = self.client.receive(MOST_ENTRIES if limit is None else min(MOST_ENTRIES, limit - given), self.wait_s)
            except OSError:  # the service can't be reached
                self._sleep(self.pause_s)
                continue
            empty = 0 if messages else empty + 1
            for handle, body in messages:
                try:
                    event = self.decode(body)
                except ValueError:
                    self.client.delete([handle])
                    continue
                given += 1
                yield handle, event

    def settle(self, acked: Iterable[str], nacked: Iterable[str] = ()) -> None:
        """Delete acked messages and make nacked ones visible at once, in batches; a partial failure is an error."""
        for call, handles in ((self.client.delete, list(acked)), (self.client.release, list(nacked))):
            for i in range(0, len(handles), MOST_ENTRIES):
                if failed := call(handles[i : i + MOST_ENTRIES]):
                    raise RuntimeError(f"{len(failed)} messages could not be settled")


class QueueStream(SimpleDataSourceStreamReader):
    """Messages of a queue as (handle, value); those of a micro-batch are deleted once it is committed, others come again when their time is over."""

    def __init__(self, options: dict):
        module, _, name = options["client"].partition(":")
        self.client = getattr(importlib.import_module(module), name)()
        self.most, self.polls = int(options.get("most", 1000)), int(options.get("polls", 1))
        self.held: dict[int, list[str]] = {}

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = list(QueueReader(self.client, str).read(self.most, self.polls))
        if not found:
            return iter(()), start
        end = start["batch"] + 1
        self.held[end] = [handle for handle, _ in found]
        return iter(found), {"batch": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """After a restart: what was received but not committed comes from the queue again."""
        return iter(())

    def commit(self, end: dict) -> None:
        for batch in sorted(b for b in self.held if b <= end["batch"]):
            QueueReader(self.client, str).settle(self.held.pop(batch))


class QueueSource(DataSource):
    """Format ``seqloom_queue``. Options: ``client`` (``module:function`` that makes the client), ``most`` (messages per micro-batch), ``polls`` (empty polls that end one).

    The service hands messages out one poll at a time, so the driver receives them; a micro-batch holds at most ``most``.
    """

    @classmethod
    def name(cls) -> str:
        return "seqloom_queue"

    def schema(self) -> str:
        return "handle string, value string"

    def simpleStreamReader(self, schema) -> QueueStream:
        return QueueStream(self.options)


def queue_writer(make_client: Callable[[], QueueClient]) -> Callable[[Iterator], Iterator]:
    """Function for ``mapInPandas`` that sends the wire texts of ``value`` in batches and yields how many were sent per partition.

    The client is made on the worker. A body larger than a batch is an error, as is a partial failure.
    """

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        client, step = make_client(), batches(MOST_ENTRIES, MOST_BYTES)()
        waiting: list[str] = []
        current, sent = 0, 0

        def flush() -> int:
            if waiting and (failed := client.send(list(waiting))):
                raise RuntimeError(f"{len(failed)} messages were not taken")
            n = len(waiting)
            waiting.clear()
            return n

        for part in parts:
            for body in part["value"]:
                (number,) = step(0, len(body.encode()))
                if number < 0:
                    raise ValueError(f"a message is larger than {MOST_BYTES} bytes")
                if number != current:
                    sent, current = sent + flush(), number
                waiting.append(body)
        sent += flush()
        yield pd.DataFrame({"sent": [sent]})

    return run
