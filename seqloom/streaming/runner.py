"""Consumers: a stream, a handler given as Columns, and sinks by outcome.

Each micro-batch is handled, its rows are routed by outcome and written under the number of the batch, replacing what a failed
attempt at the same batch may have left; so a batch that Spark repeats after a failure is not written twice. The offset is committed
only after the sinks are.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqloom.functions.ids import event_key_of
from seqloom.operators.filters import settled


def file_stream(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """A directory of Parquet files as a stream; the number of files per trigger is the rate limit."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


NAME = re.compile(r"[A-Za-z0-9_.-]{1,128}")


@dataclass
class Consumer:
    """Handles a stream and writes each outcome below ``sink``: ``ok``, ``error`` and whatever else ``outcome`` yields.

    ``outcome`` is a Column made when the batch runs; null is an error. Every row is written under the name of its outcome: the outcomes that are not among
    ``outcomes`` have a folder of their own each as well, made when one comes. Names are counted in each batch, so there should be few.
    """

    source: DataFrame
    outcome: Callable[[], Column]
    sink: str
    checkpoint: str
    outcomes: tuple[str, ...] = ("ok", "error")
    counts: dict[str, int] = field(default_factory=dict)

    def handle(self, batch: DataFrame, number: int) -> None:
        done = batch.withColumn("outcome", F.coalesce(self.outcome(), F.lit("error"))).persist()
        try:
            met = {r["outcome"]: r["n"] for r in done.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
            for name in sorted({*self.outcomes, *met}):
                if not NAME.fullmatch(name):
                    raise ValueError(f"{name!r} is no name of an outcome")
                done.where(F.col("outcome") == name).drop("outcome").write.mode("overwrite").parquet(f"{self.sink}/{name}/batch={number}")
                self.counts[name] = self.counts.get(name, 0) + met.get(name, 0)
        finally:
            done.unpersist()

    def start(self, *, until_end: bool = False, every: str = "1 second") -> StreamingQuery:
        """``until_end`` takes what is there and ends; else the stream is followed until it is stopped."""
        writer = self.source.writeStream.foreachBatch(self.handle).option("checkpointLocation", self.checkpoint)
        return (writer.trigger(availableNow=True) if until_end else writer.trigger(processingTime=every)).start()


def deduplicated(stream: DataFrame, *, event_time: str | None = None, lateness: str = "1 day") -> DataFrame:
    """One row per event, ids compared as UUIDs; rows without id are no events and pass. With an event time the memory of ids is bounded by the lateness; without
    one it holds every id there has been, so that an event is left out however late it comes again."""
    # rows without id must not be taken for one another
    keyed = stream.withColumn("_event", F.coalesce(event_key_of(F.col("id")), F.encode(F.concat_ws(":", F.lit("none"), F.col("sequence").cast("string")), "UTF-8")))
    if event_time is None:
        return keyed.dropDuplicates(["_event"]).drop("_event")
    return keyed.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["_event"]).drop("_event")


def _gate(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    mark = state.get[0] if state.exists else None
    rows = pd.concat(list(parts)).sort_values("sequence", kind="stable")
    us = rows["us"].to_numpy()
    # a row passes if it is after the greatest before it, passed or not: a row that didn't pass was not greater
    before = np.concatenate([[np.iinfo(np.int64).min if mark is None else mark], us[:-1]])
    passed = us > np.maximum.accumulate(before)
    if passed.any():
        state.update((int(us[passed][-1]),))
    yield rows[passed].drop(columns="us")


def monotone_gate(stream: DataFrame, key: str) -> DataFrame:
    """Rows whose timestamp is after all that passed before for their key; the stream needs ``sequence`` and ``timestamp``.

    The state of a key is one number. A micro-batch brings a task one key's rows of that batch, which the source's rate limit bounds.
    """
    schema = stream.schema
    timed = stream.where(F.col("timestamp").isNotNull()).withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp")))
    return timed.groupBy(key).applyInPandasWithState(_gate, schema, "mark bigint", "append", GroupStateTimeout.NoTimeout)


def period_counts(stream: DataFrame, *, period: str = "1 hour", lateness: str = "6 hours") -> DataFrame:
    """Counts per organization and period of event time; late rows correct a period until the lateness is over."""
    timed = stream.withColumn("at", F.col("timestamp").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy("organization", F.window("at", period).alias("w")).agg(F.count("*").alias("n")).select("organization", F.col("w.start").alias("period"), "n")


def ok_if(condition: Column) -> Column:
    """Outcome of a handler that succeeds on a condition."""
    return F.when(settled(condition), "ok").otherwise("error")


def supervised(start: Callable[[], StreamingQuery], *, retries: int = 3, base_s: float = 0.1, multiplier: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a query to its end, starting it again from its checkpoint after a failure, with longer waits; returns the restarts.

    The count of failures in a row starts anew whenever a run makes progress. The last error is raised.
    """
    if multiplier < 1:
        raise ValueError("a multiplier is at least 1")
    failed, restarts = 0, 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return restarts
        except Exception:
            failed = 1 if any(p.numInputRows for p in query.recentProgress) else failed + 1
            if failed > retries:
                raise
            restarts += 1
            sleep(base_s * multiplier ** (failed - 1))


def inspected(rows: DataFrame, **hooks: Column) -> tuple[DataFrame, Observation]:
    """``rows`` with counters that are filled as they pass by: each hook is a condition; ``seen`` counts all."""
    seen = Observation()
    return rows.observe(seen, F.count("*").alias("seen"), *(F.count_if(settled(c)).alias(k) for k, c in hooks.items())), seen
