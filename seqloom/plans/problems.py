"""Queries of the data-processing problems 1 to 6, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import heavy_keys, hierarchy, incremental, late_events, orphans, schema_drift
from seqloom.plans import sql
from seqloom.plans.registry import Registry
from seqloom.plans.scratch import Scratch
from seqloom.sources.tables import table

registry = Registry()


@registry.add("p1_found", sql.P1_FOUND)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.late_rows(table(spark, d, "event_log"), table(spark, d, "watermarks"))


@registry.add("p1_period_counts", sql.P1_PERIOD_COUNTS)
def p1_period_counts(spark: SparkSession, d: str) -> DataFrame:
    return late_events.period_counts(table(spark, d, "event_log"), table(spark, d, "watermarks"))


@registry.add("p1_batches", sql.P1_PERIOD_COUNTS)
def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same counts from a state that three batches of arrivals have adjusted, each classified against what the ones before have left."""
    return late_events.period_counts(table(spark, d, "event_log"), table(spark, d, "watermarks"), batches=3)


@registry.add("p2_found", sql.P2_FOUND)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.heavy_values(table(spark, d, "event_log"), heavy_keys.LOG_FIELDS)


@registry.add("p2_key_totals", sql.P2_KEY_TOTALS)
def p2_key_totals(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.key_totals(table(spark, d, "event_log"), heavy_keys.LOG_FIELDS, sequence="sequence", timestamp="timestamp")


@registry.add("p3_found", sql.P3_FOUND)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphan_references(table(spark, d, "event_log"), table(spark, d, "multiplexer_completions"), table(spark, d, "dedupe"))
    return found.drop("day")


@registry.add("p3_counts", sql.P3_COUNTS)
def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = orphans.orphan_counts(table(spark, d, "event_log"), table(spark, d, "multiplexer_completions"), table(spark, d, "dedupe"))
    return counts.withColumn("day", counts["day"].cast("string"))


@registry.add("p4_found", sql.P4_FOUND)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending(table(spark, d, "event_log"), table(spark, d, "offsets"))


def stored_rows(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The log's rows, one for each sequence, and its last sequence."""
    log = table(spark, d, "event_log").where("sequence is not null").dropDuplicates(["sequence"])
    return log, table(spark, d, "event_log").agg(F.coalesce(F.max("sequence"), F.lit(0))).head()[0]


@registry.add("p4_changes", sql.P4_CHANGES)
def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed in the log since an earlier run that saw its first four fifths, with other payloads on one topic of its second half and with rows that are gone since."""
    log, top = stored_rows(spark, d)
    job = incremental.Incremental(spark, Scratch(spark, "job").path("base"))
    other = (F.col("topic") == "cart.updated") & (F.col("sequence") > F.floor(F.lit(top) / 2))
    before = log.where(F.col("sequence") <= F.floor(F.lit(top * 4) / 5)).withColumn("payload", F.when(other, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    none = [F.lit(None).cast(t).alias(c) for c, t in log.dtypes if c != "sequence"]
    gone = table(spark, d, "events").select((-1 - F.col("event_id")).alias("sequence"), *none)
    job.run(before.unionByName(gone), "sequence", lambda rows: rows.select("sequence"))
    return job.differences(log, "sequence").select(F.col("key").alias("sequence"), "change")


@registry.add("p4_reruns", sql.P4_RERUNS)
def p4_reruns(spark: SparkSession, d: str) -> DataFrame:
    """Output of a job on a growing log: a run, one that fails half-way, the same again, and one with nothing new."""
    log, top = stored_rows(spark, d)
    scratch = Scratch(spark, "job")
    job = incremental.Incremental(spark, scratch.path("base"))

    def numbered(n: int):
        return lambda rows: rows.select("sequence", "topic", F.lit(n).alias("run"))

    def failing(rows: DataFrame) -> DataFrame:
        numbered(2)(rows).where(F.col("topic") < "m").write.parquet(scratch.path("half"))
        raise RuntimeError("half-way")

    job.run(log.where(F.col("sequence") <= F.floor(F.lit(top) / 2)), "sequence", numbered(1))
    try:
        job.run(log, "sequence", failing)
    except RuntimeError:
        pass
    job.run(log, "sequence", numbered(3))
    job.run(log, "sequence", numbered(4))
    return job.output().select("sequence", "topic", "run")


@registry.add("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, d, "event_log"))


@registry.add("p5_table")
def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, d, "event_log"))


@registry.add("p6_found", sql.P6_FOUND)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.tree_places(table(spark, d, "event_log"))


@registry.add("p6_paths", sql.P6_PATHS)
def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.tree_paths(table(spark, d, "event_log"))


@registry.add("p6_descendants", sql.P6_DESCENDANTS)
def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "event_log"))


@registry.add("p6_cycles", sql.P6_CYCLES)
def p6_cycles(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycles(table(spark, d, "event_log"))
