"""Subscriptions: where to start, where to stop, what to select and how much.

A subscription compiles to predicates on ``sequence`` and ``timestamp``; positions that depend on the log's end are one aggregate each, which
for Parquet is answered from statistics. With an organization in the filter the end is the organization's own.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.envelope import envelope_error, namespace_of
from seqloom.functions.ids import uuid_key
from seqloom.operators.filters import EventFilter


class InvalidCursor(ValueError):
    """A start position that doesn't belong to the stream it is used for."""


@dataclass(frozen=True)
class StartFrom:
    """earliest, latest (the default), timestamp (inclusive) or after (exclusive)."""

    kind: str = "latest"
    value: int | str | None = None

    @staticmethod
    def after(cursor: int) -> StartFrom:
        return StartFrom("after", cursor)


@dataclass(frozen=True)
class StopAt:
    """never (the default), current_end (inclusive) or cursor (inclusive)."""

    kind: str = "never"
    value: int | None = None


@dataclass(frozen=True)
class Partitions:
    """A selection of partitions of one count; rows without partition never match a selection."""

    count: int
    ids: Sequence[int]

    def column(self) -> Column:
        return (F.col("partition_count") == self.count) & (F.col("partition_id").isin(list(self.ids)) if self.ids else F.lit(False))


@dataclass(frozen=True)
class Subscription:
    start: StartFrom = field(default_factory=StartFrom)
    stop: StopAt = field(default_factory=StopAt)
    filter: EventFilter = field(default_factory=EventFilter)
    partitions: Partitions | None = None
    limit: int | None = None
    batch: int = 100

    def __post_init__(self) -> None:
        object.__setattr__(self, "batch", min(1000, max(1, self.batch)))

    def with_starts(self, starts: Iterable[StartFrom]) -> Subscription:
        """Resume at the least ``after`` of several stored positions; other kinds are ignored."""
        found = [s.value for s in starts if s.kind == "after"]
        return Subscription(StartFrom.after(min(found)) if found else self.start, self.stop, self.filter, self.partitions, self.limit, self.batch)


def end_of(log: DataFrame, organization: str | None = None, column: str = "sequence") -> DataFrame:
    """One row: the greatest sequence (of an organization), 0 for none."""
    rows = log if organization is None else log.where(F.col("organization") == organization)
    return rows.agg(F.coalesce(F.max(column), F.lit(0)).alias("end"))


def checked(rows: DataFrame) -> DataFrame:
    """``rows``, of which the first that breaks a rule of the envelope ends the read with an error."""
    error = envelope_error(F.col("organization"), namespace_of(F.col("namespace")), F.col("topic"), F.col("event_key"), F.col("content_type"), F.col("metadata"))
    error = F.coalesce(error, F.when(uuid_key(F.col("id")).isNull(), "id"))
    fine = F.when(error.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("serialization error: no event, "), error)).cast("boolean"))
    return rows.where(fine)


def scan(log: DataFrame, sub: Subscription, *, as_of: int | None = None, strict: bool = False) -> DataFrame:
    """The rows a subscription delivers, in order where it has a limit.

    ``as_of`` freezes the log's end as seen at the start: ``latest`` starts behind it and ``current_end`` stops at it. Null sequences are never
    delivered; an empty log gives no rows; a limit of 0 gives none. With ``strict`` a row that is no valid event ends the read (:func:`checked`); the filter comes first.
    """
    rows = log.where(F.col("sequence").isNotNull())
    seen = rows if as_of is None else rows.where(F.col("sequence") <= as_of)
    if sub.start.kind == "after":
        rows = rows.where(F.col("sequence") > F.lit(sub.start.value))
    elif sub.start.kind == "timestamp":
        rows = rows.where(F.col("timestamp") >= F.lit(str(sub.start.value)).cast("timestamp_ntz"))
    elif sub.start.kind == "latest":
        rows = rows.where(F.col("sequence") > F.lit(_end(seen, sub)))
    elif sub.start.kind != "earliest":
        raise InvalidCursor(sub.start.kind)
    if sub.stop.kind == "cursor":
        rows = rows.where(F.col("sequence") <= F.lit(sub.stop.value))
    elif sub.stop.kind == "current_end":
        rows = rows.where(F.col("sequence") <= F.lit(_end(seen, sub)))
    rows = rows.where(sub.filter.column())
    if sub.partitions is not None:
        rows = rows.where(sub.partitions.column())
    rows = rows if sub.limit is None else rows.orderBy("sequence").limit(sub.limit)
    return checked(rows) if strict else rows


def _end(rows: DataFrame, sub: Subscription) -> int:
    return end_of(rows, sub.filter.organization).head()[0]


def compatible_start(cursors: Iterable[tuple[int, int]], count: int) -> StartFrom:
    """Least position among (partition_count, position) cursors of the wanted count; none of them is an error."""
    found = [p for c, p in cursors if c == count]
    if not found:
        raise InvalidCursor(f"no cursor of {count} partitions")
    return StartFrom.after(min(found))


def branch_starts(starts: Iterable[tuple[str | None, StartFrom]]) -> dict[str, list[StartFrom]]:
    """Starts of a merge by branch: a start with a branch goes there, one without goes to both sides."""
    out: dict[str, list[StartFrom]] = {"left": [], "right": []}
    for branch, start in starts:
        for name in [branch] if branch else out:
            out[name].append(start)
    return out
