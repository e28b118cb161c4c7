"""Ordered folds: operators whose next state depends on all rows before.

A stream is all rows of a combination of keys. Rows are sorted by the engine, which spills, and pass through the fold one Arrow batch at a time; no stream is
gathered. The state is small and goes through the whole stream, so one task reads a stream's rows: give keys that split the log.

Null order values are left out; ties of the order are taken in the order of the value columns; null keys are a stream of their own; empty input gives no rows.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(rows: DataFrame, keys: dict[str, Column], values: dict[str, Column], start: Callable[[], Callable], out: dict[str, str], order: str = "sequence", many: bool = False) -> DataFrame:
    """(keys, order, out): each stream goes through a new step made by ``start``.

    ``step(order, *values)`` is called in order and returns the tuple of ``out`` (name -> type). With ``many`` it returns any number of tuples, and
    ``step.finish()``, called at the end of the stream, gives further ones; all stand under the last row that had come.
    """
    names = [*keys, order, *values]
    picked = rows.where(F.col(order).isNotNull()).select(*(c.alias(k) for k, c in keys.items()), F.col(order), *(c.alias(k) for k, c in values.items()))
    ordered = (picked.repartition(*keys) if keys else picked.coalesce(1)).sortWithinPartitions(*names)
    width = len(keys)
    schema = ", ".join([*(f"{k} {picked.schema[k].dataType.simpleString()}" for k in [*keys, order]), *(f"{k} {t}" for k, t in out.items())])
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    result_types = [arrow[t] for t in out.values()]

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, step = None, None
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != stream:
                    stream, step = row[:width], start()
                made.append(step(*row[width:]))
            results = list(zip(*made, strict=True)) or [()] * len(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], *(pa.array(r, t) for r, t in zip(results, result_types, strict=True))], [*names[: width + 1], *out])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, step, place, types = None, None, None, None

        def given(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], [*names[: width + 1], *out])

        for batch in batches:
            made = []
            types = types or [*(c.type for c in batch.columns[: width + 1]), *result_types]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != stream:
                    made += [(*place, *x) for x in step.finish()] if step else []
                    stream, step = row[:width], start()
                place = row[: width + 1]
                made += [(*place, *x) for x in step(*row[width:])]
            if made:
                yield given(made)
        if step and (made := [(*place, *x) for x in step.finish()]):
            yield given(made)

    return ordered.mapInArrow(several if many else single, schema)


def windows(size: int, wait_us: int) -> Callable[[], Callable]:
    """Micro-windows: closed at ``size`` rows or ``wait_us`` after the first row's time, whichever comes first. Gives the window's number."""

    def start() -> Callable:
        number, count, opened = -1, 0, 0

        def step(_: int, us: int) -> tuple[int]:
            nonlocal number, count, opened
            if number < 0 or count >= size or us > opened + wait_us:
                number, count, opened = number + 1, 0, us
            count += 1
            return (number,)

        return step

    return start


def bounded_memory(capacity: int) -> Callable[[], Callable]:
    """De-duplication with a first-in, first-out memory of ids; seeing an id again doesn't refresh it. Gives whether the row is delivered; rows without id always are."""

    def start() -> Callable:
        seen: OrderedDict[str, None] = OrderedDict()

        def step(_: int, id_: str | None) -> tuple[bool]:
            if id_ is None:
                return (True,)
            if id_ in seen:
                return (False,)
            seen[id_] = None
            if len(seen) > capacity:
                seen.popitem(last=False)
            return (True,)

        return step

    return start


def batches(entries: int, size: int) -> Callable[[], Callable]:
    """Greedy packing into batches of at most so many entries and bytes; an entry larger than a batch is rejected (-1)."""

    def start() -> Callable:
        number, count, held = 0, 0, 0

        def step(_: int, n: int) -> tuple[int]:
            nonlocal number, count, held
            if n > size:
                return (-1,)
            if count and (count >= entries or held + n > size):
                number, count, held = number + 1, 0, 0
            count, held = count + 1, held + n
            return (number,)

        return step

    return start


def grouped_requests(limit: int, wait_us: int | None = None) -> Callable[[], Callable]:
    """Requests of several events gathered until at least ``limit`` events wait, or ``wait_us`` after the first of them came; a request is never split, so a flush may exceed the limit."""

    def start() -> Callable:
        number, waiting, opened = 0, 0, 0

        def step(_: int, n: int, us: int = 0) -> tuple[int]:
            nonlocal number, waiting, opened
            if waiting and wait_us is not None and us > opened + wait_us:
                number, waiting = number + 1, 0
            if not waiting:
                opened = us
            here = number
            waiting += n
            if waiting >= limit:
                number, waiting = number + 1, 0
            return (here,)

        return step

    return start


def deepest_lane(lanes: int, capacity: int) -> Callable[[], Callable]:
    """Depth-weighted lane service, with instant acks and buffers kept as full as they can be.

    The lane served last keeps its turn while it has rows: a burst that reaches its maximum starts to count anew. Then the deepest lane is next, of equals the first
    one behind the last. A row enters its lane at once where that holds fewer than ``capacity`` rows; else rows are served until it has room, and the rows behind
    it wait. Gives (served, lane, position), position counting from 1; ``finish`` serves what waits at the end, by the same rule.
    """

    def start() -> Callable:
        waiting: list[deque[int]] = [deque() for _ in range(lanes)]
        last, position = 0, 0

        def serve() -> tuple[int, int, int]:
            nonlocal last, position
            if not waiting[last]:
                last = max(((last + i) % lanes for i in range(1, lanes + 1)), key=lambda k: len(waiting[k]))
            position += 1
            return (waiting[last].popleft(), last, position)

        def step(sequence: int, lane: int) -> list[tuple[int, int, int]]:
            served = []
            while len(waiting[lane]) >= capacity:
                served.append(serve())
            waiting[lane].append(sequence)
            return served

        def finish() -> Iterator[tuple[int, int, int]]:
            while any(waiting):
                yield serve()

        step.finish = finish
        return step

    return start


def flushes(count: int, interval_us: int) -> Callable[[], Callable]:
    """Checkpoints of acks that are flushed at every ``count``-th one or at the first that comes ``interval_us`` after the first that waits; at the end what waits is flushed.

    Gives (position, cause), the greatest position acked since the last flush; for acks in any order.
    """

    def start() -> Callable:
        waiting, first, top = 0, 0, 0

        def step(_: int, position: int, us: int) -> list[tuple[int, str]]:
            nonlocal waiting, first, top
            first, top, waiting = (us, position, 1) if not waiting else (first, max(top, position), waiting + 1)
            cause = "count" if waiting >= count else "interval" if us - first >= interval_us else None
            if cause:
                waiting = 0
            return [(top, cause)] if cause else []

        step.finish = lambda: [(top, "end")] if waiting else []
        return step

    return start


def permits(count: int) -> Callable[[], Callable]:
    """A limit of rows in flight: each takes the permit that is free first, and starts when it has come and has the permit. Gives the start."""

    def start() -> Callable:
        free = [-(1 << 62)] * count

        def step(_: int, us: int, takes_us: int) -> tuple[int]:
            began = max(us, heapq.heappop(free))
            heapq.heappush(free, began + takes_us)
            return (began,)

        return step

    return start
