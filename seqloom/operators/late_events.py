"""Per-period aggregates over late and out-of-order events.

Rows arrive in ``sequence`` order and happened at ``timestamp``; a period is one hour of event time. The state is a value-count multiset: for each
organization and period, how often each value was seen. A batch of rows, late ones among them, only changes counts in it (:func:`adjust`), so exact
medians, distincts and extremes come back from cumulative counts and rows that came before are never read again (:class:`State`).

What was late follows from the same kind of state, kept per *arrival block* (a fixed range of sequences): the multiset of periods and of saved watermarks. The greatest
value with a count over all earlier blocks, and over all earlier batches, is the frontier or the cut-off that a row meets on arrival. Only inside a block are rows
compared one by one, so the ordered part of the work is split evenly however the rows are spread over keys; a key that holds a third of the log is cut into as
many blocks as its rows span.

Defined results: rows without sequence, id, organization or timestamp belong to no period and are left out; repeated
rows and redeliveries count once (first rows); an empty log or an empty watermark table gives an empty or an unfiltered
result; equal timestamps are ties that all count; columns beyond those named here are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.plans.scratch import Scratch
from seqloom.sources.tables import first_rows

BLOCK = 1 << 15
"""Sequences in an arrival block."""

COARSE = 1 << 8
"""Values in one coarse cell of the cumulative counts."""

SAVE_KEY = r"^([a-z0-9_-]+)@([0-9]{1,18})$"


def valid_saves(watermarks: DataFrame) -> DataFrame:
    """(organization, sequence, ts): of several saves with one key the one updated last.

    Keys of any other form than ``<organization>@<sequence>`` belong to other readers and are dropped, as are rows with
    a null key or ts. Ties of ``updated_at`` take the later ts.
    """
    kept = watermarks.select("key", "ts", "updated_at").where(F.col("key").rlike(SAVE_KEY))
    last = kept.groupBy("key").agg(F.max(F.struct("updated_at", "ts")).alias("s"))
    return last.select(
        F.regexp_extract("key", SAVE_KEY, 1).alias("organization"),
        F.regexp_extract("key", SAVE_KEY, 2).cast("bigint").alias("sequence"),
        F.col("s.ts").alias("ts"),
    ).where(F.col("ts").isNotNull())


def arrivals(log: DataFrame, **values: Column) -> DataFrame:
    """First rows as (organization, sequence, timestamp, period, block) and the columns given by name."""
    rows = first_rows(log, organization=F.col("organization"), timestamp=F.col("timestamp"), **values)
    rows = rows.where(F.col("organization").isNotNull() & F.col("timestamp").isNotNull()).drop("event")
    return rows.withColumn("period", F.date_trunc("hour", "timestamp").cast("timestamp_ntz")).withColumn("block", F.floor(F.col("sequence") / F.lit(BLOCK)))


def classify(rows: DataFrame, saves: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``rows`` of :func:`arrivals` with ``outcome``: on_time, corrected or dropped.

    dropped: the timestamp is not after the greatest watermark saved, for the organization, at a lower sequence.
    corrected: not dropped, and an earlier row of the organization, dropped or not, lies in a later period.
    ``before`` (organization, seen, cut) is what earlier batches have left: their latest period and greatest watermark.
    """
    extra = [c for c in rows.columns if c not in ("organization", "sequence", "timestamp", "period", "block")]
    none = lambda kind: F.lit(None).cast(kind)
    marks = saves.select(
        "organization", "sequence", none("timestamp_ntz").alias("timestamp"), none("timestamp_ntz").alias("period"),
        F.floor(F.col("sequence") / F.lit(BLOCK)).alias("block"), *(none(rows.schema[c].dataType).alias(c) for c in extra), F.col("ts").cast("timestamp_ntz").alias("ts"),
    )
    both = rows.select("organization", "sequence", "timestamp", "period", "block", *extra).withColumn("ts", none("timestamp_ntz")).unionByName(marks)

    # the multisets of periods and of saves by arrival block in one: how often each pair of (period, save), one of them null, was seen
    at = ["organization", "block"]
    state = multiset(both, at, F.struct("period", "ts"))
    tops = state.where("n > 0").groupBy(*at).agg(F.max("value.period").alias("p"), F.max("value.ts").alias("w"))
    if before is not None:
        tops = tops.unionByName(before.select("organization", F.lit(-(1 << 62)).alias("block"), F.col("seen").alias("p"), F.col("cut").alias("w")))
    earlier = Window.partitionBy("organization").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entry = tops.select(*at, F.max("p").over(earlier).alias("seen"), F.max("w").over(earlier).alias("cut"))

    # a save made right after row s comes after that row
    inside = Window.partitionBy(*at).orderBy("sequence", F.col("ts").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    met = both.withColumn("frontier", F.max("period").over(inside)).withColumn("mark", F.max("ts").over(inside)).where(F.col("timestamp").isNotNull())
    met = met.join(entry, at)
    cut = F.greatest("mark", "cut")
    seen = F.greatest("frontier", "seen")
    outcome = F.when(F.col("timestamp") <= cut, "dropped").when(seen > F.col("period"), "corrected").otherwise("on_time")
    return met.select("organization", "sequence", "timestamp", "period", "block", *extra, outcome.alias("outcome"))


def late_rows(log: DataFrame, watermarks: DataFrame) -> DataFrame:
    """(sequence, outcome) of the rows that came too late for their period."""
    found = classify(arrivals(log), valid_saves(watermarks))
    return found.where(F.col("outcome") != "on_time").select("sequence", "outcome")


def _counted(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """What a batch changes: a count of one for each row. It is combined on the map side when it meets the state."""
    return rows.select(*keys, value.alias("value")).where(F.col("value").isNotNull()).withColumn("n", F.lit(1).cast("bigint"))


def multiset(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The state: (keys, value, n). Add a late batch with :func:`adjust`. Null values count nothing."""
    return _counted(rows, keys, value).groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def adjust(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """State after a late batch: counts are added, values whose count falls to 0 vanish (``n`` may be negative in ``delta``)."""
    return state.unionByName(delta).groupBy(*keys, "value").agg(F.sum("n").alias("n")).where("n <> 0")


def derive(state: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, n_distinct, lowest, highest, median) from a multiset of whole numbers, by cumulative counts.

    The median of an even number of values is the mean of the middle two. Counts are cumulated twice, over coarse cells
    of ``COARSE`` values and then inside the one or two cells that hold the middle ranks, so no task walks all distinct
    values of a period.
    """
    cells = state.withColumn("cell", F.floor(F.col("value") / F.lit(COARSE))).groupBy(*keys, "cell").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.min("value").alias("lowest"), F.max("value").alias("highest")
    )
    upto = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    cells = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    holds = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    totals = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_distinct").alias("n_distinct"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
    middle = cells.where(holds(low) | holds(high)).select(*keys, "cell", (F.col("upto") - F.col("n")).alias("before"), "total")
    fine = state.withColumn("cell", F.floor(F.col("value") / F.lit(COARSE))).join(middle, [*keys, "cell"])
    fine = fine.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    medians = fine.groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2).alias("median")
    )
    return totals.join(medians, keys)


PERIOD = ["organization", "period"]
OUTCOME = [*PERIOD, "outcome"]


@dataclass
class State:
    """Counts after all batches so far: ``sizes`` (OUTCOME, value, n) of payload sizes by outcome, ``keys`` (PERIOD, value, n) of the event keys of rows that
    count, and ``cuts`` (organization, value, n) of the watermarks saved. ``end`` is the last sequence taken in, None before the first batch."""

    sizes: DataFrame
    keys: DataFrame
    cuts: DataFrame
    end: int | None = None

    @staticmethod
    def empty(spark: SparkSession) -> State:
        place = "organization string, period timestamp_ntz"
        return State(*(spark.createDataFrame([], f"{x}, n bigint") for x in (f"{place}, outcome string, value int", f"{place}, value string", "organization string, value timestamp_ntz")))

    def frontier(self) -> DataFrame:
        """(organization, seen, cut): the extremes of the counts."""
        seen = self.sizes.where("n > 0").groupBy("organization").agg(F.max("period").alias("seen"))
        return seen.join(self.cuts.where("n > 0").groupBy("organization").agg(F.max("value").alias("cut")), "organization", "full")

    def advance(self, rows: DataFrame, saves: DataFrame, end: int, scratch: Scratch, *, last: bool = False) -> State:
        """The state after the rows and saves of sequences up to ``end`` that came since; ``rows`` are :func:`arrivals` with size and event_key, and every event's first row.

        The batch is classified against the frontier of the state, and its counts are added; the rows of earlier batches are not needed. After the ``last`` batch
        only what is read more than once is written.
        """
        since = F.lit(True) if self.end is None else F.col("sequence") > self.end
        new = lambda df: df.where(since & (F.col("sequence") <= end))
        rows, saves = new(rows), new(saves)
        found = scratch.keep(classify(rows, saves, None if self.end is None else self.frontier()).select(*OUTCOME, "size", "event_key"), "batch")
        kept = found.where(F.col("outcome") != "dropped")
        parts = {
            "sizes": (OUTCOME, _counted(found, OUTCOME, F.col("size"))),
            "keys": (PERIOD, _counted(kept, PERIOD, F.col("event_key"))),
            "cuts": (["organization"], _counted(saves, ["organization"], F.col("ts").cast("timestamp_ntz"))),
        }
        made = {k: adjust(getattr(self, k), delta, keys) for k, (keys, delta) in parts.items()}
        return State(**{k: scratch.keep(x, k) if k == "sizes" or not last else x for k, x in made.items()}, end=end)

    def counts(self) -> DataFrame:
        """Per organization and period: rows on time, corrected, dropped, the corrected count and the exact median, distinct number and extremes of the
        payload size in bytes of the rows that count, and the number of distinct event keys. All from counts."""
        n = self.sizes.groupBy(*PERIOD).agg(*(F.sum(F.when(F.col("outcome") == o, F.col("n")).otherwise(0)).alias(f"n_{o}") for o in ("on_time", "corrected", "dropped")))
        sizes = derive(self.sizes.where(F.col("outcome") != "dropped").groupBy(*PERIOD, "value").agg(F.sum("n").alias("n")), PERIOD)
        distinct = self.keys.groupBy(*PERIOD).agg(F.count("*").alias("n_keys"))
        out = n.join(sizes, PERIOD, "left").join(distinct, PERIOD, "left")
        number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        return out.select(
            *PERIOD, "n_on_time", "n_corrected", "n_dropped", number("n").alias("n_events"), number("n_keys"), number("n_distinct").alias("n_sizes"),
            F.col("lowest").cast("bigint").alias("min_size"), F.col("highest").cast("bigint").alias("max_size"), F.col("median").cast("double").alias("median_size"),
        )


def period_counts(log: DataFrame, watermarks: DataFrame, batches: int = 1) -> DataFrame:
    """:meth:`State.counts` of a whole log, taken in as so many batches of equal ranges of sequences. The number of batches doesn't change the result."""
    scratch = Scratch(log.sparkSession, "late-state")
    rows = arrivals(log, size=F.octet_length(F.coalesce("payload", F.lit(""))), event_key=F.col("event_key"))
    if batches > 1:
        rows = scratch.keep(rows, "arrivals")
    saves = valid_saves(watermarks)
    first, last = log.agg(F.coalesce(F.min("sequence"), F.lit(0)), F.coalesce(F.max("sequence"), F.lit(0))).head()
    state = State.empty(log.sparkSession)
    for i in range(1, batches + 1):
        state = state.advance(rows, saves, first + (last - first) * i // batches, scratch, last=i == batches)
    return state.counts()
