"""Conjunctive event filters and their combinators, as Column predicates that the optimizer pushes into the scan.

Every predicate is two-valued: a null column never matches, and the negation of a non-match matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.envelope import namespace_within


def settled(condition: Column) -> Column:
    """Null as false."""
    return F.coalesce(condition, F.lit(False))


@dataclass(frozen=True)
class EventFilter:
    """All given conditions together: organization, exact topic, namespace prefix by whole parts, set of keys, metadata pairs that
    must be present and equal, and an inclusive end of time. An empty set of keys matches nothing."""

    organization: str | None = None
    topic: str | None = None
    namespace: str | None = None
    keys: Sequence[str] | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    end_at: datetime | str | None = None

    def column(self) -> Column:
        found: list[Column] = []
        if self.organization is not None:
            found.append(F.col("organization") == self.organization)
        if self.topic is not None:
            found.append(F.col("topic") == self.topic)
        if self.namespace is not None:
            found.append(namespace_within(F.col("namespace"), self.namespace))
        if self.keys is not None:
            found.append(F.col("event_key").isin(list(self.keys)) if self.keys else F.lit(False))
        found += [F.try_element_at("metadata", F.lit(k)) == v for k, v in sorted(self.metadata.items())]
        if self.end_at is not None:
            found.append(F.col("timestamp") <= F.lit(str(self.end_at)).cast("timestamp_ntz"))
        return reduce(lambda a, b: a & b, found) if found else F.lit(True)


@dataclass(frozen=True)
class Combined:
    """Several filters as one; made into a Column only when it is used."""

    how: str
    filters: tuple

    def column(self) -> Column:
        each = [settled(column(f)) for f in self.filters]
        if self.how == "not":
            return ~each[0]
        if self.how == "all":
            return reduce(lambda a, b: a & b, each, F.lit(True))
        return reduce(lambda a, b: a | b, each, F.lit(False))


Filter = EventFilter | Combined | Column


def column(f: Filter) -> Column:
    return f if isinstance(f, Column) else f.column()


def all_of(*filters: Filter) -> Combined:
    """True for none."""
    return Combined("all", filters)


def any_of(*filters: Filter) -> Combined:
    """False for none."""
    return Combined("any", filters)


def negate(f: Filter) -> Combined:
    return Combined("not", (f,))
