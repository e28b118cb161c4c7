"""Filling containers of fixed capacity with items of varying length.

Vector best-fit: a container has a residual for each capacity (tokens, number of documents, attention cost, which is the sum of squared
lengths). Items come longest first; an item goes to the container that takes it under every constraint and has the smallest weighted
norm of residuals afterwards, and to a new container if none takes it. Items longer than a container are cut first, into full containers
and a rest; nothing else is ever cut, and full containers take no part in the search.

Items are spread over shards of about ``SHARD`` items by a hash that has nothing to do with their length or source, and each shard is packed by
one task. The shards' number follows the items', so a task's work is bounded, and a shard leaves no more than a few containers
part empty.

Defined results: an item of 0 tokens (null or empty text) has a row with null container; repeated rows are packed each; a null key is
kept; an empty table gives no rows; every token lands in exactly one container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.tokens import token_counts
from seqloom.plans.scratch import Scratch

CAPACITY = 2048
MOST_DOCUMENTS = 512
ATTENTION = CAPACITY * CAPACITY
SHARD = 8192
ALONE = 1 << 52
"""Numbers of containers that one piece fills start here; a shard's are its number times 2 ** 24 and up."""

WEIGHTS = (1.0, 0.05, 0.05)
"""Of tokens, documents and attention cost in the norm of residuals."""


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY, documents: int = MOST_DOCUMENTS, attention: int = ATTENTION, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Container number of each item; ``sizes`` must not exceed what an empty container takes."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    full = np.array([capacity, documents, attention], float)
    scale = np.sqrt(np.array(weights)) / full
    room = np.empty((64, 3))  # residuals of open containers
    number = np.empty(64, np.int64)
    open_, made = 0, 0
    least = np.minimum.accumulate(sizes[order][::-1])[::-1] if len(sizes) else sizes
    for step, item in enumerate(order):
        size = float(sizes[item])
        need = np.array([size, 1.0, size * size])
        if step % 256 == 0 and open_:  # close what no later item can enter
            keep = (room[:open_, 0] >= least[-1]) & (room[:open_, 1] >= 1)
            n = int(keep.sum())
            room[:n], number[:n] = room[:open_][keep], number[:open_][keep]
            open_ = n
        left = room[:open_] - need
        fits = (left >= 0).all(axis=1)
        if fits.any():
            norm = np.where(fits, ((left * scale) ** 2).sum(axis=1), np.inf)
            at = int(norm.argmin())
        else:
            if open_ == len(room):
                room, number = np.concatenate([room, np.empty_like(room)]), np.concatenate([number, np.empty_like(number)])
            at = open_
            room[at], number[at] = full, made
            open_, made = open_ + 1, made + 1
        room[at] -= need
        out[item] = number[at]
    return out


ROWS = "container bigint, doc_id bigint, piece int, start int, n_tokens int"


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", *, capacity: int = CAPACITY, documents: int = MOST_DOCUMENTS, attention: int | None = None) -> DataFrame:
    """(container, doc_id, piece, start, n_tokens): where the tokens ``start`` to ``start + n_tokens`` of each item go.

    ``attention`` defaults to the cost of one item that fills a container, the least that lets any item in.
    """
    attention = attention or capacity * capacity
    most = min(capacity, int(attention**0.5))
    # materialised: rows are numbered, and the sizes cost a pass over all texts
    sizes = Scratch(sizes.sparkSession, "packing").keep(sizes.select(F.col(key).alias("doc_id"), F.col(size).cast("int").alias("size")), "sizes")
    cuts = F.sequence(F.lit(0), F.floor((F.col("size") - 1) / F.lit(most)).cast("int"))
    items = sizes.where("size > 0").select("doc_id", "size", F.monotonically_increasing_id().alias("row"), F.explode(cuts).alias("piece"))
    items = items.select("row", "doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("size") - F.col("piece") * most).alias("n_tokens"))
    # a piece that fills a container needs no search; so a text of any length adds at most one item to a shard
    whole = items.where(F.col("n_tokens") == capacity)
    items = items.where(F.col("n_tokens") < capacity)
    left = F.when(F.lit(most == capacity), (F.col("size") % most > 0).cast("bigint")).otherwise(F.ceil(F.col("size") / F.lit(most)).cast("bigint"))
    shards = max(1, (sizes.where("size > 0").agg(F.sum(left)).head()[0] or 0) // SHARD)
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards)))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece"], kind="stable")
        number = best_fit(part.n_tokens.to_numpy(), capacity, documents, attention)
        return part.assign(container=part.shard.iloc[0] * (1 << 24) + number)[["container", "doc_id", "piece", "start", "n_tokens"]]

    packed = items.groupBy("shard").applyInPandas(one, ROWS)
    void = sizes.where("size <= 0 or size is null").select(F.lit(None).cast("bigint").alias("container"), F.col("doc_id").cast("bigint"), F.lit(0).alias("piece"), F.lit(0).alias("start"), F.lit(0).alias("n_tokens"))
    alone = whole.select((F.lit(ALONE) + F.monotonically_increasing_id()).alias("container"), F.col("doc_id").cast("bigint").alias("doc_id"), "piece", "start", "n_tokens")
    return packed.unionByName(alone).unionByName(void)


def containers(texts: DataFrame, path: str | None = None) -> DataFrame:
    """The documents packed by their length in tokens."""
    return pack(token_counts(texts, path=path))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, n_pieces, n_tokens, unused, attention_cost) of every container."""
    n = F.col("n_tokens").cast("bigint")
    by = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum(n).alias("n_tokens"), F.sum(n * n).alias("attention_cost"))
    return by.select("container", "n_pieces", "n_tokens", (F.lit(capacity) - F.col("n_tokens")).alias("unused"), "attention_cost")
