"""Queries of the text problems 7 to 9, each over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import packing, privacy, tokens
from seqloom.plans.registry import Registry
from seqloom.sources.tables import table

registry = Registry()


@registry.add("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


@registry.add("p7_counts")
def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents"))


@registry.add("p7_round_trip", "select doc_id, coalesce(text, '') as text from documents")
def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids; null text comes back empty."""
    back = tokens.decoded(tokens.token_ids(table(spark, d, "documents")))
    return back.select("doc_id", F.col("text"))


@registry.add("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"))


@registry.add("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.containers(table(spark, d, "documents")))


@registry.add("p8_bounded")
def p8_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Containers in which all three capacities bind: 2,048 tokens, 4 documents, and the attention cost of half a container filled by one."""
    return packing.pack(tokens.token_counts(table(spark, d, "documents")), documents=4, attention=packing.ATTENTION // 4)


@registry.add("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return privacy.personal_items(table(spark, d, "documents"), table(spark, d, "contributors"), privacy.key_of(spark)).select("doc_id", "kind", "value")


@registry.add("p9_items")
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """The items with the surrogates they are exchanged for."""
    return privacy.personal_items(table(spark, d, "documents"), table(spark, d, "contributors"), privacy.key_of(spark))


@registry.add("p9_redacted")
def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return privacy.redacted(table(spark, d, "documents"), table(spark, d, "contributors"))


@registry.add("p9_surrogates")
def p9_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return privacy.disguised(table(spark, d, "documents"), table(spark, d, "contributors"), privacy.key_of(spark))
