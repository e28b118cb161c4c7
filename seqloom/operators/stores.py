"""State stores as snapshots: checkpoints, buffers, claims and partition leases.

A snapshot operator tells what a store's state makes possible or has become; each is one aggregate or one join on the store's key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.incremental import position_of
from seqloom.operators.ordering import block_of, numbered

SCOPE = ["consumer_group_id", "stream_id"]


# ---- checkpoints ----


def monotone_checkpoints(commits: DataFrame) -> DataFrame:
    """(scope, cursor_id, cursor, position): of all commits to a cursor the one of greatest order; an order of other than 8 bytes, or null, says nothing.

    Of several commits of one order the greatest cursor text counts.
    """
    rows = commits.where(F.octet_length("cursor_order") == 8)
    best = rows.groupBy(*SCOPE, "cursor_id").agg(F.max(F.struct("cursor_order", "cursor")).alias("c"))
    return best.select(*SCOPE, "cursor_id", F.col("c.cursor").alias("cursor"), position_of(F.col("c.cursor"), F.col("c.cursor_order")).alias("position"))


def resume_after(checkpoints: DataFrame, where: Column | None = None) -> DataFrame:
    """(scope, start): the least position of a scope's cursors."""
    rows = checkpoints if where is None else checkpoints.where(where)
    return rows.where(F.col("position").isNotNull()).groupBy(*SCOPE).agg(F.min("position").alias("start"))


def remaining_counts(log: DataFrame, marks: DataFrame, position: str) -> DataFrame:
    """(scope, n, first): how many rows, and the first of them, lie behind each scope's position in the log; scopes with none are left out.

    The log is counted in blocks of sequences. Positions are laid among the blocks' totals in order, so what lies in later blocks is a running
    sum over the totals, and only a position's own block is counted row by row.
    """
    log = log.select("sequence").where(F.col("sequence").isNotNull()).withColumn("block", block_of("sequence"))
    totals = log.groupBy("block").agg(F.count("*").alias("n"), F.min("sequence").alias("first"))
    marks = marks.where(F.col(position).isNotNull()).select(*SCOPE, F.col(position).alias("position"), block_of(position).alias("block"))
    none = [F.lit(None).cast("string").alias(c) for c in SCOPE]
    laid = totals.select("block", "n", "first", *none, F.lit(False).alias("mark")).unionByName(marks.select("block", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("first"), *SCOPE, F.lit(True).alias("mark")))
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("block"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, -1)
    behind = laid.withColumn("behind", F.coalesce(F.sum("n").over(later), F.lit(0))).withColumn("next", F.min("first").over(later)).where("mark").select(*SCOPE, F.col("behind").alias("n"), F.col("next").alias("first"))
    own = marks.join(log, "block").where(F.col("sequence") > F.col("position")).groupBy(*SCOPE).agg(F.count("*").alias("n"), F.min("sequence").alias("first"))
    return behind.unionByName(own).groupBy(*SCOPE).agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 0")


def contiguous(rows: DataFrame, acked: Column, keys: Sequence[str]) -> DataFrame:
    """(keys, checkpoint): the greatest sequence before which every delivered row of the key is acked; null where the first isn't."""
    flagged = rows.withColumn("_ok", F.coalesce(acked, F.lit(False)))
    first = flagged.groupBy(*keys).agg(F.min(F.when(~F.col("_ok"), F.col("sequence"))).alias("_open"))
    met = flagged.select(*keys, "sequence").join(F.broadcast(first) if not keys else first, list(keys))
    return met.groupBy(*keys).agg(F.max(F.when(F.col("_open").isNull() | (F.col("sequence") < F.col("_open")), F.col("sequence"))).alias("checkpoint"))


def flush_points(acks: DataFrame, every: int, keys: Sequence[str]) -> DataFrame:
    """(keys, flush, sequence): commits of a policy that flushes at every n-th ack of a key."""
    placed = numbered(acks, "sequence", keys=tuple(keys))
    return placed.where(F.col("rn") % every == 0).select(*keys, (F.col("rn") / every).cast("bigint").alias("flush"), "sequence")


def resume_or_initial(commits: DataFrame, *, invalid: str = "initial") -> DataFrame:
    """(scope, start): the least position of a scope's cursors; where one of them can't be read at all, 0 for the initial start, or with ``invalid="error"`` an error."""
    by = commits.groupBy(*SCOPE, "cursor_id").agg(F.max(position_of(F.col("cursor"), F.col("cursor_order"))).alias("position"))
    out = by.groupBy(*SCOPE).agg(F.min("position").alias("start"), F.bool_or(F.col("position").isNull()).alias("_broken"))
    none = F.lit(0).cast("bigint") if invalid == "initial" else F.raise_error(F.lit("a stored cursor is unreadable")).cast("bigint")
    return out.select(*SCOPE, F.when(F.col("_broken"), none).otherwise(F.col("start")).alias("start"))


def pending_stops(rows: DataFrame, acked: Column, keys: Sequence[str], most: int) -> DataFrame:
    """(keys, open, pending, stopped_at): the first row of a key that isn't acked, how many rows from it on wait for it, and the row at which a reader that
    lets ``most`` wait for each key stops with an error (null where it doesn't)."""
    flagged = rows.where(F.col("sequence").isNotNull()).withColumn("_ok", F.coalesce(acked, F.lit(False))).select(*keys, "sequence", "_ok")
    first = flagged.where(~F.col("_ok")).groupBy(*keys).agg(F.min("sequence").alias("open"))
    waiting = numbered(flagged.join(first, list(keys)).where(F.col("sequence") >= F.col("open")), "sequence", keys=tuple(keys))
    return waiting.groupBy(*keys, "open").agg(F.count("*").alias("pending"), F.min(F.when(F.col("rn") > most, F.col("sequence"))).alias("stopped_at"))


def snapshots(rows: DataFrame, keys: Sequence[str], state: Sequence[str]) -> DataFrame:
    """(keys, state, sequence): the state of the latest row of each key and the sequence it covers; null sequences are left out."""
    kept = rows.where(F.col("sequence").isNotNull())
    return kept.groupBy(*keys).agg(F.max("sequence").alias("sequence"), F.max_by(F.struct(*state), "sequence").alias("_s")).select(*keys, "_s.*", "sequence")


# ---- claims ----


def claimable(now: str) -> Column:
    """Rows that are free or whose claim has run out."""
    return F.col("claimed_until").isNull() | (F.col("claimed_until") < F.lit(now).cast("timestamp_ntz"))


def claim(items: DataFrame, now: str, most: int, *, order: str = "id", per: Sequence[str] = ()) -> DataFrame:
    """The next ``most`` claimable items in order, per key where given, with attempts counted up.

    A limit is the feature here; with ``per`` the engine keeps only the first items of a key before it shuffles.
    """
    free = items.where(claimable(now))
    if per:
        place = Window.partitionBy(*per).orderBy(order)
        free = free.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).drop("_n")
    else:
        free = free.orderBy(order).limit(most)
    return free.withColumn("attempts", F.col("attempts") + 1)


# ---- leases ----


def live(consumers: DataFrame, now: str) -> DataFrame:
    """(scope, n_live): consumers whose lease is not over."""
    up = F.col("lease_until") > F.lit(now).cast("timestamp_ntz")
    return consumers.groupBy(*SCOPE).agg(F.count_if(up).alias("n_live"))


def lease_open(owner: str, now: str) -> Column:
    """Whether ``owner`` may claim a partition: unowned, no lease, run out, or its own."""
    return F.col("owner_id").isNull() | F.col("lease_until").isNull() | (F.col("lease_until") < F.lit(now).cast("timestamp_ntz")) | (F.col("owner_id") == owner)


def fenced(leases: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits (scope, partition_id, owner_id, generation, position) against the leases, with ``accepted`` and ``checkpoint_after``.

    Only the owner of the current generation is heard; an older position from it changes nothing and is no error.
    """
    at = [*SCOPE, "partition_id"]
    held = leases.select(*at, F.col("owner_id").alias("_owner"), F.col("generation").alias("_generation"), "checkpoint_sequence")
    met = commits.join(held, at)
    ok = F.coalesce((F.col("owner_id") == F.col("_owner")) & (F.col("generation") == F.col("_generation")), F.lit(False))
    after = F.when(ok, F.greatest("checkpoint_sequence", "position")).otherwise(F.col("checkpoint_sequence"))
    return met.withColumn("accepted", ok).withColumn("checkpoint_after", after).drop("_owner", "_generation")


def target_count(total: Column, consumers: Column, slack: int = 0) -> Column:
    """Partitions an owner should hold: an even share rounded up, plus slack, at most all."""
    return F.least(F.ceil(total / F.greatest(consumers, F.lit(1))) + slack, total).cast("bigint")


def releases(leases: DataFrame, slack: int = 0) -> DataFrame:
    """(scope, owner_id, partition_id) that owners above their target give back, highest partitions first.

    An owner's partitions of a scope are as many as a scope has partitions, a fixed number.
    """
    owned = leases.where(F.col("owner_id").isNotNull())
    shape = leases.groupBy(*SCOPE).agg(F.count("*").alias("total"), F.count_distinct("owner_id").alias("owners"))
    own = Window.partitionBy(*SCOPE, "owner_id")
    ranked = owned.withColumn("_high", F.row_number().over(own.orderBy(F.desc("partition_id")))).withColumn("_owned", F.count("*").over(own)).join(shape, SCOPE)
    return ranked.where(F.col("_high") <= F.col("_owned") - target_count(F.col("total"), F.col("owners"), slack)).select(*SCOPE, "owner_id", "partition_id")


def next_claims(leases: DataFrame, owner: str, now: str, consumers: int) -> DataFrame:
    """(scope, partition_id) that ``owner`` claims next: open partitions it doesn't hold, lowest first, up to its target."""
    held = F.coalesce(F.col("owner_id") == owner, F.lit(False)) & F.coalesce(F.col("lease_until") >= F.lit(now).cast("timestamp_ntz"), F.lit(False))
    shape = leases.groupBy(*SCOPE).agg(F.count("*").alias("total"), F.count_if(held).alias("owned"))
    free = leases.where(lease_open(owner, now) & ~held).withColumn("_n", F.row_number().over(Window.partitionBy(*SCOPE).orderBy("partition_id"))).join(shape, SCOPE)
    return free.where(F.col("_n") <= target_count(F.col("total"), F.lit(consumers)) - F.col("owned")).select(*SCOPE, "partition_id")


def shared_start(leases: DataFrame) -> DataFrame:
    """(scope, start): least checkpoint if all partitions of the scope have one (above 0), else 0 for the earliest row."""
    have = F.coalesce(F.col("checkpoint_sequence"), F.lit(0)) > 0
    by = leases.groupBy(*SCOPE).agg(F.count("*").alias("_all"), F.count_if(have).alias("_have"), F.min("checkpoint_sequence").alias("_least"))
    return by.select(*SCOPE, F.when(F.col("_all") == F.col("_have"), F.col("_least")).otherwise(F.lit(0)).cast("bigint").alias("start"))
