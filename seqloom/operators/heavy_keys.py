"""Per-key results where a few keys hold most rows.

Dense accumulator arrays: every input split, whatever keys it holds, is dictionary-encoded and reduced with numpy
(``bincount`` for counts, scatter minimum and maximum for the rest) to one array per accumulator and key block. Splits are
equal shares of the bytes, so a key that holds a third of all rows costs each split the same as any other. What leaves a split is at
most one entry per distinct key, and blocks of arrays are summed in a tree of rounds, so the reducing task of a hot key's block gets ``FAN`` arrays
however many splits there are, and never its rows.

Defined results: a null value of a field has its own entry with ``is_null``; empty text is a value like any other;
repeated rows all count (every stored row); an empty table gives no rows. Null sequences and timestamps are ignored by
the accumulators they would feed. Columns not named by the caller are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 18
"""Rows behind one key block: a table of N rows gets N / BLOCK_ROWS blocks (8 at least), so that a block's dense arrays hold at
most about BLOCK_ROWS entries even where every key is distinct."""

FAN = 32
"""Partial arrays merged by one task of a round; there are so many rounds that the last task gets no more of them either."""

PARTIAL = "field int, block int, lane int, names array<string>, n array<bigint>, last array<bigint>, lo array<bigint>, hi array<bigint>"
TOP, BOTTOM = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class Accumulator:
    """Growing dictionary and dense arrays of one field: count, greatest sequence, least and greatest time."""

    def __init__(self) -> None:
        self.code: dict[str | None, int] = {}
        self.n = np.zeros(0, np.int64)
        self.last = np.zeros(0, np.int64)
        self.lo = np.zeros(0, np.int64)
        self.hi = np.zeros(0, np.int64)

    def slots(self, names: list[str | None]) -> np.ndarray:
        """Dense codes of the names; new names get the next codes."""
        code = self.code
        at = np.fromiter((code.setdefault(x, len(code)) for x in names), np.int64, len(names))
        if grow := len(code) - len(self.n):
            self.n = np.concatenate([self.n, np.zeros(grow, np.int64)])
            self.last = np.concatenate([self.last, np.full(grow, BOTTOM)])
            self.lo = np.concatenate([self.lo, np.full(grow, TOP)])
            self.hi = np.concatenate([self.hi, np.full(grow, BOTTOM)])
        return at

    def add(self, slots: np.ndarray, n: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        np.add.at(self.n, slots, n)
        np.maximum.at(self.last, slots, last)
        np.minimum.at(self.lo, slots, lo)
        np.maximum.at(self.hi, slots, hi)

    def rows(self, values: pa.Array, sequence: np.ndarray | None, lo: np.ndarray | None, hi: np.ndarray | None) -> None:
        """Add stored rows: encode the values, reduce them densely, scatter into the arrays."""
        coded = values.dictionary_encode(null_encoding="encode")
        local, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        slots, k = self.slots(local), len(local)
        dense = [np.bincount(index, minlength=k).astype(np.int64)]
        for column, neutral, at in ((sequence, BOTTOM, np.maximum), (lo, TOP, np.minimum), (hi, BOTTOM, np.maximum)):
            array = np.full(k, neutral)
            if column is not None:
                at.at(array, index, column)
            dense.append(array)
        self.add(slots, *dense)

    def blocks(self, field: int, lane: int, count: int) -> Iterator[dict]:
        """The arrays cut into key blocks, names in order within a block."""
        by: dict[int, list[tuple[str, int]]] = {}
        for name, i in self.code.items():
            by.setdefault(-1 if name is None else zlib.crc32(name.encode()) % count, []).append((name, i))
        for block, pairs in by.items():
            at = np.array([i for _, i in pairs])
            yield {"field": field, "block": block, "lane": lane, "names": [x for x, _ in pairs], "n": self.n[at], "last": self.last[at], "lo": self.lo[at], "hi": self.hi[at]}


def _long(column: pa.Array, fill: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), fill).to_numpy(zero_copy_only=False)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    some: list[dict] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_pylist(some, schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


SCHEMA = pa.schema(
    [("field", pa.int32()), ("block", pa.int32()), ("lane", pa.int32()), ("names", pa.list_(pa.string()))] + [(x, pa.list_(pa.int64())) for x in ("n", "last", "lo", "hi")]
)


def _split(fields: int, spans: bool, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [Accumulator() for _ in range(fields)]
        for batch in batches:
            extra = (None, None, None)
            if spans:
                stamp = batch.column(fields + 1)
                extra = (_long(batch.column(fields), BOTTOM), _long(stamp, TOP), _long(stamp, BOTTOM))
            for k, part in enumerate(parts):
                part.rows(batch.column(k), *extra)
        lane = TaskContext.get().partitionId() // FAN
        yield from _batches((row for k, part in enumerate(parts) for row in part.blocks(k, lane, count)), SCHEMA)

    return run


def _merge(table: pa.Table) -> tuple[int, int, Accumulator]:
    whole = Accumulator()
    names = table.column("names").combine_chunks().flatten().to_pylist()
    arrays = [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("n", "last", "lo", "hi")]
    whole.add(whole.slots(names), *arrays)
    return table.column("field")[0].as_py(), table.column("block")[0].as_py(), whole


def _reduce(table: pa.Table) -> pa.Table:
    """Arrays of one block and lane summed into one."""
    field, block, whole = _merge(table)
    row = {"field": field, "block": block, "lane": table.column("lane")[0].as_py() // FAN, "names": list(whole.code), "n": whole.n, "last": whole.last, "lo": whole.lo, "hi": whole.hi}
    return pa.Table.from_pylist([row], SCHEMA)


FINAL = "field int, val string, n bigint, last_sequence bigint, first_us bigint, last_us bigint"


def _finish(table: pa.Table) -> pa.Table:
    """All arrays of one block summed; one row per key."""
    field, _, whole = _merge(table)
    names = list(whole.code)
    void = lambda array, none: pa.array(array, pa.int64(), mask=array == none)
    return pa.table({
        "field": pa.array(np.full(len(names), field), pa.int32()), "val": pa.array(names, pa.string()), "n": pa.array(whole.n),
        "last_sequence": void(whole.last, BOTTOM), "first_us": void(whole.lo, TOP), "last_us": void(whole.hi, BOTTOM),
    })


def key_totals(rows: DataFrame, fields: list[str], *, sequence: str | None = None, timestamp: str | None = None, total: int | None = None) -> DataFrame:
    """One row per field and value: (field, val, is_null, n, last_sequence, first_ts, last_ts).

    ``sequence`` and ``timestamp`` name the columns of the span accumulators; without them only counts are made and
    only the fields' own columns are read. ``total`` is the number of rows where it is known.
    """
    spans = sequence is not None and timestamp is not None
    columns = [F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)]
    if spans:
        columns += [F.col(sequence).cast("bigint").alias("s"), F.unix_micros(F.col(timestamp).cast("timestamp")).alias("t")]
    split = rows.select(*columns)
    parts = split.mapInArrow(_split(len(fields), spans, max(8, (total or rows.count()) // BLOCK_ROWS)), PARTIAL)
    lanes = -(-split.rdd.getNumPartitions() // FAN)
    while lanes > 1:
        parts, lanes = parts.groupBy("field", "block", "lane").applyInArrow(_reduce, PARTIAL), -(-lanes // FAN)
    done = parts.groupBy("field", "block").applyInArrow(_finish, FINAL)
    name = F.element_at(F.array(*(F.lit(f) for f in fields)), F.col("field") + 1)
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return done.select(name.alias("field"), "val", F.col("val").isNull().alias("is_null"), "n", "last_sequence", stamp("first_us").alias("first_ts"), stamp("last_us").alias("last_ts"))


LOG_FIELDS = ["event_key", "partition_key", "partition_id"]


def heavy_values(log: DataFrame, fields: list[str], share: float = 0.03) -> DataFrame:
    """(field, val) of the non-null values that at least ``share`` of all stored rows hold.

    The number of rows is the sum of any one field's accumulators; it is taken from the table's own row count, which
    for Parquet is metadata.
    """
    total = log.count()
    part = Fraction(str(share))  # exact, so that a value on the border counts
    return key_totals(log, fields, total=total).where(~F.col("is_null") & (F.col("n") * part.denominator >= part.numerator * total)).select("field", "val")
