"""References to records that do not exist.

All keys go into one long form: a row for each parent key (an event's id, an id once processed) and for each child key
(a reference), tagged with its table. One aggregate by key keeps the groups that lack the parent tag, or whose parent came
after its child. It combines on the map side, so a key that a third of all rows refer to is one row per input split at the
shuffle. Only the kept groups, one row each, go back to their references.

Defined results: null and blank references, and causation ids that are no UUID, refer to nothing; so does a parent id
that is no UUID. Rows without sequence or id are no events. Repeated rows, redeliveries and repeated pairs count once. Empty
tables give an empty result. Spellings of one UUID are one key. Columns not named here are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.ids import is_blank, uuid_key, uuid_text
from seqloom.operators.lookup import skew_safe_lookup
from seqloom.plans.scratch import Scratch
from seqloom.sources.tables import first_rows

PARENT, CAUSE, DONE = "event_log.parent_id", "event_log.causation_id", "multiplexer_completions.event_id"


def _references(events: DataFrame, completions: DataFrame) -> DataFrame:
    """(ref, src, seq, row_key, day): references singly; ``seq`` only where the child is a log row."""
    log = events.select(
        F.explode(F.array(F.struct(F.col("parent").alias("ref"), F.lit(PARENT).alias("src")), F.struct(F.col("cause").alias("ref"), F.lit(CAUSE).alias("src")))).alias("r"),
        F.col("sequence").alias("seq"), "day",
    ).select("r.ref", "r.src", "seq", F.col("seq").cast("string").alias("row_key"), "day")
    done = completions.select(
        uuid_key(F.col("event_id")).alias("ref"), F.lit(DONE).alias("src"), F.lit(None).cast("bigint").alias("seq"),
        F.col("subscriber_id").alias("row_key"), F.to_date("completed_at").alias("day"),
    ).where(F.col("row_key").isNotNull())
    done = done.groupBy("ref", "src", "seq", "row_key").agg(F.min("day").alias("day"))
    return log.unionByName(done).where(F.col("ref").isNotNull())


def orphan_references(log: DataFrame, completions: DataFrame, dedupe: DataFrame) -> DataFrame:
    """(src, ref_id, row_key, kind, day) of every reference without a record to refer to.

    kind: ``deleted`` if only the table of processed ids has the id, ``missing`` if nothing has it, ``late`` (log only)
    if the event's first row has a higher sequence than the row that refers to it.
    """
    scratch = Scratch(log.sparkSession, "orphans")
    events = first_rows(
        log, parent=F.when(~is_blank(F.col("parent_id")), uuid_key(F.col("parent_id"))), cause=F.when(~is_blank(F.col("causation_id")), uuid_key(F.col("causation_id"))), day=F.to_date("timestamp"),
    )
    events = scratch.keep(events, "events")
    refs = scratch.keep(_references(events, completions), "refs")

    tag = lambda name: F.lit(1).alias(name)
    none = lambda name, kind="int": F.lit(None).cast(kind).alias(name)
    long = (
        events.select(F.col("event").alias("ref"), F.col("sequence").alias("born"), none("gone"), none("first_child", "bigint"), none("child"))
        .unionByName(dedupe.select(uuid_key(F.col("event_id")).alias("ref"), none("born", "bigint"), tag("gone"), none("first_child", "bigint"), none("child")).where(F.col("ref").isNotNull()))
        .unionByName(refs.select("ref", none("born", "bigint"), none("gone"), F.col("seq").alias("first_child"), tag("child")))
    )
    groups = long.groupBy("ref").agg(F.min("born").alias("born"), F.max("gone").alias("gone"), F.min("first_child").alias("first_child"), F.max("child").alias("child"))
    lacking = groups.where(F.col("child").isNotNull() & (F.col("born").isNull() | (F.col("first_child") < F.col("born")))).select("ref", "born", "gone")
    found = skew_safe_lookup(refs, scratch.keep(lacking, "lacking"), "ref")
    kind = F.when(F.col("born").isNotNull(), "late").when(F.col("gone").isNotNull(), "deleted").otherwise("missing")
    found = found.where(F.col("born").isNull() | (F.col("seq") < F.col("born")))
    return found.select("src", uuid_text(F.col("ref")).alias("ref_id"), "row_key", kind.alias("kind"), "day")


def orphan_counts(log: DataFrame, completions: DataFrame, dedupe: DataFrame) -> DataFrame:
    """(src, day, kind, n_refs, n_ids): orphan references and distinct ids per table and day (the child's day)."""
    found = orphan_references(log, completions, dedupe)
    per_id = found.groupBy("src", "day", "kind", "ref_id").agg(F.count("*").alias("n"))
    return per_id.groupBy("src", "day", "kind").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_ids"))
