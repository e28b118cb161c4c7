"""Full hierarchies from parent-child links of unknown depth.

Level-wise frontier joins: the roots are the first frontier; each round joins the links not yet used with the frontier of the
round before, which extends paths and depths by one. A round writes both halves of its join, the new frontier and the links
still open, so links leave the loop as soon as they are placed and the whole loop moves each link few times. What is still open after ``DEEP``
levels hangs on long chains: these are contracted, each open node's pointer going twice as far up in every round until it stands on a placed node, so that a chain of a
million links takes twenty rounds and no level of its own. The links that stay open are exactly the nodes that no root reaches: cycles and what hangs below them. Their
cycle is found by doubling the links of those nodes alone. Pointers may all lead to one node; the joins on them split such a node's rows.

Defined results: a null link makes a root, and so does a link to an id that no event has; an event that is its own parent is a
cycle of one; repeated rows and redeliveries count once (first rows); empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seqloom.functions.ids import event_key_of, is_blank, uuid_key
from seqloom.operators.lookup import HOT, skew_safe_lookup
from seqloom.plans.scratch import Scratch
from seqloom.sources.tables import first_rows

DEEP = 16
"""Levels placed by frontier joins before long chains are contracted."""

SMALL = 10_000
"""A frontier of no more entries (times its paths' length) goes to the links, some 100 KB, instead of both to a shuffle; and no more open links than
this are finished in one task, since by then levels are many and nearly empty."""


def links(log: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, parent) by sequence; parent is null for roots.

    An event's parent is its parent_id or, where that is null or blank, its causation_id if this is a UUID.
    """
    parent = F.when(~is_blank(F.col("parent_id")), event_key_of(F.col("parent_id"))).otherwise(uuid_key(F.col("causation_id")))
    events = scratch.keep(first_rows(log, up=parent).withColumnRenamed("sequence", "node"), "events")
    known = events.select(F.col("event").alias("up"), F.col("node").alias("parent"))
    return skew_safe_lookup(events.select("node", "up"), known, "up", "left").select("node", "parent")


class Hierarchy:
    """Result of :func:`build`: ``reached`` (node, root, depth and path where asked for) and ``open_links`` (node, parent)."""

    def __init__(self, reached: DataFrame, open_links: DataFrame, scratch: Scratch):
        self.reached, self.open_links, self.scratch = reached, open_links, scratch

    def cyclic(self) -> DataFrame:
        """(node, low, on_cycle): nodes on or below a cycle, with the lowest node of that cycle."""
        step = self.open_links.select("node", F.col("parent").alias("to"), F.col("parent").alias("low"))
        total = self.open_links.count()
        if not total:
            return step.withColumn("on_cycle", F.lit(False)).select("node", "low", "on_cycle")
        # after this many doublings every pointer stands on a cycle, and low covers a whole turn of it
        for _ in range(max(1, math.ceil(math.log2(total)) + 1)):
            ahead = step.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("low").alias("least"))
            step = self.scratch.keep(skew_safe_lookup(step, ahead, "to", total=total).select("node", F.col("far").alias("to"), F.least("low", "least").alias("low")), "step")
        turn = step.select(F.col("node").alias("to"), F.col("low").alias("cycle_low"))
        ring = step.select(F.col("to").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
        out = skew_safe_lookup(step, turn, "to", total=total).select("node", F.col("cycle_low").alias("low")).join(ring, "node", "left")
        return out.select("node", "low", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def _contracted(rest: DataFrame, above: DataFrame, left: int, paths: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(placed, open links) of the links ``rest`` below the frontier ``above`` (parent, root, depth, path where asked for).

    A pointer that stands on a node of the frontier is done. A round in which no pointer gets there is the last: a node further down would have one above it that did.
    """
    seeds = scratch.keep(above.join(rest.select("parent").distinct(), "parent", "left_semi").withColumnRenamed("parent", "to"), "seeds")
    here = seeds.select("to", F.lit(True).alias("done"))
    first = rest.select("node", F.col("parent").alias("to"), F.lit(1).alias("dist"))
    step = scratch.keep(skew_safe_lookup(first, here, "to", "left", total=left).withColumn("done", F.coalesce("done", F.lit(False))), "step")
    rounds, waiting = 0, step.where("not done").count()
    while waiting:
        step = scratch.keep(_further(step, waiting, []), "step")
        rounds, before, waiting = rounds + 1, waiting, step.where("not done").count()
        if waiting == before:
            break
    lost = step.where("not done").select("node")
    open_links = scratch.keep(rest.join(lost, "node", "left_semi"), "open")
    found = step.where("done")
    if paths:  # only now, when what hangs on cycles is known and left out, since its paths would never end
        along = first.join(found.select("node"), "node", "left_semi").withColumn("path_", F.array("node"))
        step = scratch.keep(skew_safe_lookup(along, here, "to", "left", total=left).withColumn("done", F.coalesce("done", F.lit(False))), "step")
        for _ in range(rounds):
            if not (waiting := step.where("not done").count()):
                break
            step = scratch.keep(_further(step, waiting, ["path_"]), "step")
        found = step
    met = skew_safe_lookup(found, seeds, "to", total=left)
    path = [F.concat("path", "path_").alias("path")] if paths else []
    return scratch.keep(met.select("node", "root", (F.col("depth") + F.col("dist")).alias("depth"), *path), "level"), open_links


def _further(step: DataFrame, waiting: int, path: list[str]) -> DataFrame:
    """Pointers that are not done go on by what the node they stand on has covered."""
    ahead = step.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("dist").alias("more"), F.col("done").alias("there"), *(F.col(c).alias("upper") for c in path))
    moved = skew_safe_lookup(step.where("not done").drop("done"), ahead, "to", total=waiting)
    longer = [F.concat("upper", c).alias(c) for c in path]
    moved = moved.select("node", F.col("far").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), *longer, F.col("there").alias("done"))
    return step.where("done").unionByName(moved)


def _remaining_levels(rest: DataFrame, above: DataFrame, paths: bool) -> DataFrame:
    """(node, parent, root, depth, path where asked for, hit): the levels of the open links, one after the other from the frontier ``above`` down.

    One task gets the open links and the frontier's nodes that they name, at most twice ``SMALL`` rows, and hands on a level at a time.
    """
    place = [c for c in ("root", "depth", "path") if c in above.columns]
    seeds = above.join(rest.select("parent").distinct(), "parent", "left_semi")
    both = rest.select("node", "parent", *(F.lit(None).cast(above.schema[c].dataType).alias(c) for c in place))
    both = both.unionByName(seeds.select(F.lit(None).cast("bigint").alias("node"), "parent", *place)).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[int, list[int]] = {}
        front: list[tuple] = []
        for batch in batches:
            for node, parent, *at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node is None:
                    front.append((parent, *at))
                else:
                    below.setdefault(parent, []).append(node)
        while front:
            found, following = [], []
            for parent, root, depth, *path in front:
                for node in below.pop(parent, ()):
                    longer = [[*path[0], node]] if paths else []
                    found.append((node, parent, root, depth + 1, *longer, True))
                    following.append((node, root, depth + 1, *longer))
            if found:
                yield _batch(found)
            front = following
        if below:
            yield _batch([(node, parent, None, None, *([None] if paths else []), False) for parent, nodes in below.items() for node in nodes])

    fields = [("node", pa.int64()), ("parent", pa.int64()), ("root", pa.int64()), ("depth", pa.int32()), *([("path", pa.list_(pa.int64()))] if paths else []), ("hit", pa.bool_())]

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), fields, strict=True)], schema=pa.schema(fields))

    return both.mapInArrow(run, f"node bigint, parent bigint, root bigint, depth int, {'path array<bigint>, ' if paths else ''}hit boolean")


def build(links: DataFrame, scratch: Scratch, *, paths: bool = False) -> Hierarchy:
    """Place every node of ``links`` (node, parent; parent null for roots)."""
    spark = links.sparkSession
    links = scratch.keep(links, "links")
    path = [F.array("node").alias("path")] if paths else []
    top = links.where(F.col("parent").isNull()).select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), *path)
    found = scratch.keep(top, "level")
    places = [found]
    rest = links.where(F.col("parent").isNotNull())
    left, front, deep = rest.count(), found.count(), 1
    while left and front:
        above = places[-1].withColumnRenamed("node", "parent")
        last = left <= SMALL
        if not last and deep > DEEP:
            placed, rest = _contracted(rest, above, left, paths, scratch)
            places.append(placed)
            break
        if last:  # what is open is counted and few: all further levels in one task
            both = _remaining_levels(rest, above, paths)
        elif front * (deep if paths else 1) <= SMALL:  # a counted, bounded frontier: the links need not move at all
            both = rest.join(F.broadcast(above), "parent", "left")
        else:
            both = skew_safe_lookup(rest, above, "parent", "left", total=left)
        if not last:
            longer = [F.concat("path", F.array("node")).alias("path")] if paths else []
            both = both.select("node", "parent", "root", (F.col("depth") + 1).alias("depth"), *longer, F.col("root").isNotNull().alias("hit"))
            if left <= HOT:
                both = both.coalesce(1)
        at, seen = scratch.path("level"), Observation()
        both.observe(seen, F.count_if("hit").alias("hits")).write.option("compression", "zstd").partitionBy("hit").parquet(at)
        front, deep = seen.get["hits"], deep + 1
        wrote = spark.read.schema(both.schema).option("basePath", at).parquet(at)
        if front:
            places.append(wrote.where("hit").drop("hit", "parent"))
        rest = wrote.where("not hit").select("node", "parent")
        left -= front
        if last:
            break
    reached = places[0]
    for level in places[1:]:
        reached = reached.unionByName(level)
    return Hierarchy(reached, rest, scratch)


def tree_places(log: DataFrame) -> DataFrame:
    """(sequence, root_sequence, depth) of every event that is no root; depth -1 on or below a cycle."""
    scratch = Scratch(log.sparkSession, "hierarchy")
    tree = build(links(log, scratch), scratch)
    placed = tree.reached.where(F.col("depth") > 0).select(F.col("node").alias("sequence"), F.col("root").alias("root_sequence"), "depth")
    lost = tree.cyclic().select(F.col("node").alias("sequence"), F.col("low").alias("root_sequence"), F.lit(-1).alias("depth"))
    return placed.unionByName(lost)


def tree_paths(log: DataFrame) -> DataFrame:
    """(sequence, root_sequence, depth, path, n_descendants) of every event; roots included.

    path: sequences from the root down, joined by ``/``. On or below a cycle path is null, depth -1 and n_descendants null.
    """
    scratch = Scratch(log.sparkSession, "hierarchy")
    tree = build(links(log, scratch), scratch, paths=True)
    reached = scratch.keep(tree.reached, "reached")
    below = reached.select(F.explode(F.slice("path", 1, F.col("depth"))).alias("node")).groupBy("node").agg(F.count("*").alias("n_descendants"))
    placed = reached.join(below, "node", "left").select(
        F.col("node").alias("sequence"), F.col("root").alias("root_sequence"), "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.coalesce("n_descendants", F.lit(0)).cast("bigint").alias("n_descendants")
    )
    lost = tree.cyclic().select(
        F.col("node").alias("sequence"), F.col("low").alias("root_sequence"), F.lit(-1).alias("depth"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("n_descendants")
    )
    return placed.unionByName(lost)


def descendants(log: DataFrame) -> DataFrame:
    """(sequence, descendant_sequence, distance): ancestor pairs, one for each node and each node above it.

    As many rows as the depths add up to; nodes on or below cycles have none.
    """
    scratch = Scratch(log.sparkSession, "hierarchy")
    tree = build(links(log, scratch), scratch, paths=True)
    pairs = tree.reached.where(F.col("depth") > 0).select(F.col("node").alias("descendant_sequence"), "depth", F.posexplode(F.slice("path", 1, F.col("depth"))).alias("at", "sequence"))
    return pairs.select("sequence", "descendant_sequence", (F.col("depth") - F.col("at")).alias("distance"))


def cycles(log: DataFrame) -> DataFrame:
    """(sequence, cycle_sequence, on_cycle) of events on or below a cycle; cycle_sequence is the lowest on it."""
    scratch = Scratch(log.sparkSession, "hierarchy")
    return build(links(log, scratch), scratch).cyclic().select(F.col("node").alias("sequence"), F.col("low").alias("cycle_sequence"), "on_cycle")
