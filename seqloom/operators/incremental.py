"""Processing only new or changed records, by a Merkle tree over key-range digests.

A leaf covers ``SPAN`` consecutive keys of one tree (a partition of the log, or the whole log); its digest hashes the exclusive or of its rows'
hashes and their number, and a row's hash takes in all its columns. A node of the next level digests the digests of ``FANOUT`` children. A saved and a
current tree are compared from the top: only nodes whose digests differ are opened, and only rows of differing leaves are read and compared with the
rows that the saved leaf had. A leaf holds at most ``SPAN`` keys whatever the skew of keys and partitions, so the extraction is split evenly.

Consumers with cursors share one saved tree of the log. A consumer's own tree is that tree up to its cursor: nodes that end at or before the cursor are the
shared ones, the one node of each level that the cursor falls into has a digest of its own, later nodes are absent. So a consumer adds one digest a level,
however long the log. What was saved can be kept (:meth:`Saved.write`) and compared with a later log; then records that changed behind a cursor are found as well.
Where nothing was saved, as for cursors that another program has committed, the saved trees are made from the rows up to the cursors.

A job's own output and tree are published together (:class:`Incremental`), so that a run that fails half-way leaves the former pair in force and the next
run does the same work again: nothing skipped, nothing twice.

Defined results: redeliveries and repeated rows count once (first rows); rows without sequence or id are no events; a cursor row
without readable position says nothing; a stream with neither kind of cursor yields nothing; empty tables give empty results.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.plans.scratch import Scratch
from seqloom.sources.tables import first_rows

SPAN = 1 << 12
FANOUT = 64
"""A leaf's keys and a node's children. The height of a tree follows from its greatest key: two levels above the leaves for 10 ** 7 keys, five for 10 ** 12."""

RANGES = 1000
"""At most so many ranges of keys are pushed down into the second reading of a source; where more leaves differ, neighbouring ranges are joined."""

WHOLE = "all"
"""Name of the tree over the whole log; the others are named by partition id."""

WHO = ["consumer_group_id", "stream_id", "tree"]
PARTITION_CURSOR = r"^partition:64:([0-9]{1,9})$"


class Conflict(RuntimeError):
    """Another run has published since this one began."""


def position_of(cursor: Column, order: Column) -> Column:
    """Position of a cursor row: 8 order bytes, else the ``sequence`` of readable cursor JSON, else null."""
    number = F.conv(F.hex(order), 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")
    said = F.try_variant_get(F.try_parse_json(cursor), "$.sequence", "string")
    return F.when(F.octet_length(order) == 8, number.cast("bigint")).otherwise(F.when(said.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), F.trim(said).try_cast("bigint")))


def committed(offsets: DataFrame) -> DataFrame:
    """(consumer_group_id, stream_id, tree, pos): greatest position said by a cursor's rows, 0 if none says any.

    A partitioned stream gets all 64 partitions; a partition without cursor rows stands at 0.
    """
    rows = offsets.select("consumer_group_id", "stream_id", "cursor_id", position_of(F.col("cursor"), F.col("cursor_order")).alias("pos"))
    number = F.regexp_extract("cursor_id", PARTITION_CURSOR, 1)
    whole = F.col("cursor_id") == "global"
    part = F.col("cursor_id").rlike(PARTITION_CURSOR)
    rows = rows.where(whole | part).withColumn("tree", F.when(whole, F.lit(WHOLE)).otherwise(number.try_cast("int").cast("string")))
    said = rows.groupBy(*WHO).agg(F.coalesce(F.max("pos"), F.lit(0)).alias("pos"))
    unsaid = said.where(F.col("tree") != WHOLE).select("consumer_group_id", "stream_id").distinct()
    unsaid = unsaid.select("*", F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<string>")).alias("tree"), F.lit(0).cast("bigint").alias("pos"))
    return said.unionByName(unsaid).groupBy(*WHO).agg(F.max("pos").alias("pos"))


# ---- digests and trees ----


def row_digest(df: DataFrame) -> Column:
    """Hash of all columns of a row, in order of their names; maps by their sorted entries, variants by their text."""
    plain = {T.MapType: lambda c: F.array_sort(F.map_entries(c)), T.VariantType: lambda c: c.cast("string")}
    return F.xxhash64(*(plain.get(type(df.schema[c].dataType), lambda x: x)(F.col(f"`{c}`")) for c in sorted(df.columns)))


def _over(value: Column, by: int) -> Column:
    """Whole-number quotient rounded down; exact, where a division would go through a floating number."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by)).cast("bigint")


def leaves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, digest, n) of the leaves of ``rows`` (keys, node, digest)."""
    # the count is hashed in, because equal rows cancel out in pairs
    by = rows.groupBy(*keys, "node").agg(F.bit_xor("digest").alias("x"), F.count("*").alias("n"))
    return by.select(*keys, "node", F.xxhash64("x", "n").alias("digest"), "n")


def parents(level: DataFrame, keys: list[str]) -> DataFrame:
    """The next level up."""
    up = level.select(*keys, _over(F.col("node"), FANOUT).alias("node"), F.xxhash64("node", "digest").alias("digest"), "n")
    return up.groupBy(*keys, "node").agg(F.bit_xor("digest").alias("digest"), F.sum("n").alias("n"))


def height_of(top: int) -> int:
    """Levels above the leaves that put the keys from 0 to ``top`` under one node."""
    height = 0
    while top >= SPAN * FANOUT**height:
        height += 1
    return height


def levels(leaf: DataFrame, keys: list[str], height: int, scratch: Scratch | None = None) -> list[DataFrame]:
    """Leaves first, top last; each level kept where there is a ``scratch``, since the next one is made from it."""
    kept = lambda x: scratch.keep(x, "level") if scratch else x
    out = [kept(leaf)]
    for _ in range(height):
        out.append(kept(parents(out[-1], keys)))
    return out


def _as_high(tree: list[DataFrame], other: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """``tree`` with levels on top until it is as high as the other."""
    out = list(tree)
    while len(out) < len(other):
        out.append(parents(out[-1], keys))
    return out


def _side_by_side(now: DataFrame, then: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, now, then): digests of one level of two trees; null where a tree lacks the node."""
    if now is then:
        return now.select(*by, "node", F.col("digest").alias("now"), F.col("digest").alias("then"))
    return now.select(*by, "node", F.col("digest").alias("now")).join(then.select(*by, "node", F.col("digest").alias("then")), [*by, "node"], "full")


def differing(current: list[DataFrame], saved: list[DataFrame], by: list[str]) -> DataFrame:
    """(by, node): leaves that differ between two trees, found from the top down; leaves that only one tree has are among them."""
    opened: DataFrame | None = None
    current, saved = _as_high(current, saved, by), _as_high(saved, current, by)
    for now, then in zip(reversed(current), reversed(saved), strict=True):
        at = _side_by_side(now, then, by)
        if opened is not None:
            at = at.withColumn("above", _over(F.col("node"), FANOUT)).join(opened, [*by, "above"])
        opened = at.where(~F.col("now").eqNullSafe(F.col("then"))).select(*by, F.col("node").alias("above"))
    return opened.withColumnRenamed("above", "node")


def in_node_order(marks: DataFrame) -> DataFrame:
    """Marks laid out so that those of few leaves are read from few row groups, by the files' statistics."""
    return marks.repartition(_over(F.col("node"), FANOUT)).sortWithinPartitions("node")


# ---- consumers with cursors ----


@dataclass
class Saved:
    """What consumers had processed when they committed: ``cursors`` (WHO, pos), ``tree`` (levels of the shared tree, leaves first) and ``marks``
    (tree, node, sequence, digest), the rows it was made from."""

    cursors: DataFrame
    tree: list[DataFrame]
    marks: DataFrame

    def write(self, base: str) -> None:
        """Keep it below ``base``."""
        self.cursors.write.parquet(f"{base}/cursors")
        for i, level in enumerate(self.tree):
            level.write.parquet(f"{base}/tree-{i}")
        in_node_order(self.marks).write.parquet(f"{base}/marks")

    @staticmethod
    def read(spark: SparkSession, base: str, height: int) -> Saved:
        return Saved(spark.read.parquet(f"{base}/cursors"), [spark.read.parquet(f"{base}/tree-{i}") for i in range(height + 1)], spark.read.parquet(f"{base}/marks"))


def event_marks(log: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, node, sequence, digest) of the first rows, each in the tree of the whole log and in that of its partition.

    The hash of a row is taken where it is read, so that texts don't move.
    """
    rows = first_rows(log, partition=F.col("partition_id").cast("bigint"), digest=row_digest(log))
    rows = scratch.keep(rows.select("sequence", "partition", _over(F.col("sequence"), SPAN).alias("node"), "digest"), "rows")
    trees = F.when(F.col("partition").isNull(), F.array(F.lit(WHOLE))).otherwise(F.array(F.lit(WHOLE), F.col("partition").cast("string")))
    return rows.select(F.explode(trees).alias("tree"), "node", "sequence", "digest")


def event_tree(marks: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The trees of the marks of a log, leaves first."""
    return levels(leaves(marks, ["tree"]), ["tree"], height_of(marks.agg(F.coalesce(F.max("sequence"), F.lit(0))).head()[0]), scratch)


def saved_of(marks: DataFrame, tree: list[DataFrame], offsets: DataFrame, scratch: Scratch) -> Saved:
    """What is to be saved when the cursors of ``offsets`` are committed on a log of these marks."""
    return Saved(scratch.keep(committed(offsets), "cursors"), tree, marks)


def _ends_by(node: Column, span: int, pos: Column) -> Column:
    return node * span + (span - 1) <= pos


def _edges(saved: Saved, scratch: Scratch) -> list[DataFrame]:
    """(WHO, node, digest) for each level: the digest of the node that a consumer's cursor falls into, over what lies at or before the cursor."""
    at = saved.cursors.withColumn("node", _over(F.col("pos"), SPAN))
    rows = saved.marks.join(at, ["tree", "node"]).where(F.col("sequence") <= F.col("pos"))
    out = [scratch.keep(leaves(rows.select(*WHO, "node", "digest"), WHO).drop("n"), "edge")]
    span = SPAN
    for shared in saved.tree[:-1]:
        below, span = span, span * FANOUT
        above = saved.cursors.withColumn("above", _over(F.col("pos"), span))
        whole = shared.withColumn("above", _over(F.col("node"), FANOUT)).join(above, ["tree", "above"]).where(_ends_by(F.col("node"), below, F.col("pos")))
        own = out[-1].join(saved.cursors, WHO).where(~_ends_by(F.col("node"), below, F.col("pos"))).withColumn("above", _over(F.col("node"), FANOUT))
        parts = whole.select(*WHO, "above", "node", "digest").unionByName(own.select(*WHO, "above", "node", "digest"))
        up = parts.groupBy(*WHO, "above").agg(F.bit_xor(F.xxhash64("node", "digest")).alias("digest"))
        out.append(up.withColumnRenamed("above", "node"))
    return out


def differing_for(current: list[DataFrame], saved: Saved, scratch: Scratch) -> DataFrame:
    """(WHO, pos, node): leaves in which the log differs from what a consumer had processed, found from the top down."""
    saved = Saved(saved.cursors, _as_high(saved.tree, current, ["tree"]), saved.marks)
    current = _as_high(current, saved.tree, ["tree"])
    edges = _edges(saved, scratch)
    opened: DataFrame | None = None
    for level in reversed(range(len(current))):
        span = SPAN * FANOUT**level
        at = _side_by_side(current[level], saved.tree[level], ["tree"])
        if opened is None:
            at = at.join(saved.cursors, "tree")
        else:
            at = at.withColumn("above", _over(F.col("node"), FANOUT)).join(opened, ["tree", "above"])
        at = at.join(edges[level].withColumnRenamed("digest", "edge"), [*WHO, "node"], "left")
        then = F.when(_ends_by(F.col("node"), span, F.col("pos")), F.col("then")).otherwise(F.col("edge"))
        opened = at.where(~F.col("now").eqNullSafe(then)).select(*WHO, "pos", F.col("node").alias("above"))
    return opened.withColumnRenamed("above", "node")


def changes_for(marks: DataFrame, current: list[DataFrame], saved: Saved, scratch: Scratch) -> DataFrame:
    """(WHO, sequence, change): rows of the log that a consumer's saved tree lacks (``added``) or has with another content (``changed``).

    Leaves behind the cursor's own have no saved rows; only the rows of the other differing leaves are compared one by one.
    """
    leaf = scratch.keep(differing_for(current, saved, scratch), "differing")
    later = F.col("node") * SPAN > F.col("pos")
    fresh = marks.join(leaf.where(later), ["tree", "node"]).select(*WHO, "sequence", F.lit("added").alias("change"))
    mixed = leaf.where(~later)
    now = marks.join(mixed, ["tree", "node"]).select(*WHO, "sequence", "digest")
    old = saved.marks.join(mixed, ["tree", "node"]).where(F.col("sequence") <= F.col("pos")).select(*WHO, "sequence", F.col("digest").alias("old"))
    met = now.join(old, [*WHO, "sequence"], "left").where(~F.col("digest").eqNullSafe(F.col("old")))
    return fresh.unionByName(met.select(*WHO, "sequence", F.when(F.col("old").isNull(), "added").otherwise("changed").alias("change")))


def pending(log: DataFrame, offsets: DataFrame) -> DataFrame:
    """(consumer_group_id, stream_id, sequence) of first rows beyond what each consumer has committed."""
    scratch = Scratch(log.sparkSession, "incremental")
    marks = event_marks(log, scratch)
    tree = event_tree(marks, scratch)
    return changes_for(marks, tree, saved_of(marks, tree, offsets, scratch), scratch).select("consumer_group_id", "stream_id", "sequence")


# ---- a job with output of its own ----


class Incremental:
    """A job whose output and tree are published together below ``base``.

    Runs are numbered; ``manifest-<n>`` names what is in force after the n-th. A manifest is put in place by one rename that fails where the name is taken, so of
    two runs at once only one is published. Everything else below ``base`` is without meaning until a manifest names it.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.base).getFileSystem(self._conf)

    def current(self) -> dict | None:
        """The manifest in force: {"number", "run", "runs", "height"}."""
        if not self._fs.exists(self._path(self.base)):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.base))]
        numbers = [int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-")]
        if not numbers:
            return None
        return json.loads(self.spark.read.text(f"{self.base}/manifest-{max(numbers)}", wholetext=True).head()[0])

    def output(self) -> DataFrame | None:
        """All published output."""
        now = self.current()
        return self.spark.read.parquet(*(f"{self.base}/run-{r}/output" for r in now["runs"])) if now else None

    def _publish(self, run: str, runs: list[str], before: dict | None, height: int) -> None:
        number = (before["number"] if before else 0) + 1
        temporary = self._path(f"{self.base}/run-{run}/manifest")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(json.dumps({"number": number, "run": run, "runs": runs, "height": height}).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        target = self._path(f"{self.base}/manifest-{number}")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf).rename(temporary, target, none)
        except Exception as e:
            if self._fs.exists(target):
                raise Conflict(f"run {number} was published by another") from e
            raise

    def _marks(self, source: DataFrame, key: str, at: str) -> tuple[DataFrame, int]:
        """The rows of ``source`` as marks, and the height of their tree, both written below ``at``: one reading, and the source as this run sees it."""
        rows = source.where(F.col(key).isNotNull())
        marks = rows.select(F.lit(WHOLE).alias("tree"), _over(F.col(key).cast("bigint"), SPAN).alias("node"), F.col(key).cast("bigint").alias("key"), row_digest(source).alias("digest"))
        in_node_order(marks).write.mode("overwrite").parquet(f"{at}/marks")
        marks = self.spark.read.schema(marks.schema).parquet(f"{at}/marks")
        height = height_of(marks.agg(F.coalesce(F.max("key"), F.lit(0))).head()[0])
        level = leaves(marks, ["tree"])
        for i in range(height + 1):
            level.write.mode("overwrite").parquet(f"{at}/tree-{i}")
            level = parents(self.spark.read.schema(level.schema).parquet(f"{at}/tree-{i}"), ["tree"])
        return marks, height

    def _tree(self, at: str, height: int) -> list[DataFrame]:
        return [self.spark.read.schema("tree string, node bigint, digest bigint, n bigint").parquet(f"{at}/tree-{i}") for i in range(height + 1)]

    def differences(self, source: DataFrame, key: str, at: str | None = None) -> DataFrame:
        """(key, change): records ``added``, ``changed`` or ``deleted`` since the run in force; ``key`` is a whole-number column, unique where it isn't null.

        Saved and current tree are compared from the top down and only the marks of differing leaves are read.
        """
        at = at or Scratch(self.spark, "incremental").path("run")
        (marks, height), now = self._marks(source, key, at), self.current()
        if now is None:
            return marks.select("key", "digest", F.lit("added").alias("change"))
        before = f"{self.base}/run-{now['run']}"
        leaf = differing(self._tree(at, height), self._tree(before, now["height"]), ["tree"]).select("node")
        leaf = Scratch(self.spark, "incremental").keep(leaf, "leaf")
        ranges = _ranges(leaf)
        within = reduce(lambda a, b: a | b, (F.col("node").between(a, b) for a, b in ranges), F.lit(False))
        here = marks.where(within).join(leaf, "node", "left_semi").select("key", "digest")
        there = self.spark.read.parquet(f"{before}/marks").where(within).join(leaf, "node", "left_semi").select("key", F.col("digest").alias("old"))
        met = here.join(there, "key", "full").where(~F.col("digest").eqNullSafe(F.col("old")))
        return met.select("key", "digest", F.when(F.col("old").isNull(), "added").when(F.col("digest").isNull(), "deleted").otherwise("changed").alias("change"))

    def changes(self, source: DataFrame, key: str, at: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows added or changed since the run in force, the differences themselves). Rows where the key is null are left out.

        The rows are those whose digests the tree was made from: what the source got in between is left to the next run. The ranges of keys of differing
        leaves are pushed down to the source.
        """
        scratch = Scratch(self.spark, "incremental")
        found = scratch.keep(self.differences(source, key, at), "differences")
        fresh = found.where("change <> 'deleted'").select(F.col("key").alias("__key"), F.col("digest").alias("__digest"))
        ranges = _ranges(fresh.select(_over(F.col("__key"), SPAN).alias("node")))
        within = reduce(lambda a, b: a | b, (F.col(key).between(a * SPAN, b * SPAN + SPAN - 1) for a, b in ranges), F.lit(False))
        rows = source.where(within).withColumn("__digest", row_digest(source)).withColumn("__key", F.col(key).cast("bigint"))
        return rows.join(fresh, ["__key", "__digest"], "left_semi").select(*source.columns), found

    def run(self, source: DataFrame, key: str, process) -> str:
        """Process the changes and publish output and tree together; returns the run's id.

        ``process`` maps the changed rows to the output rows. If it fails, nothing is published; neither is it if another run was first (:class:`Conflict`).
        """
        now = self.current()
        run = uuid.uuid4().hex
        at = f"{self.base}/run-{run}"
        fresh, _ = self.changes(source, key, at)
        process(fresh).write.parquet(f"{at}/output")
        self._publish(run, [*(now["runs"] if now else []), run], now, self._height(at))
        return run

    def _height(self, at: str) -> int:
        return sum(f.getPath().getName().startswith("tree-") for f in self._fs.listStatus(self._path(at))) - 1

    def compact(self) -> None:
        """Put the output of all runs into one, so that neither manifest nor reading grows with the number of runs; the tree in force stays."""
        now = self.current()
        if now is None or len(now["runs"]) < 2:
            return
        run = uuid.uuid4().hex
        at = f"{self.base}/run-{run}"
        self.output().write.parquet(f"{at}/output")
        in_node_order(self.spark.read.parquet(f"{self.base}/run-{now['run']}/marks")).write.parquet(f"{at}/marks")
        for i, level in enumerate(self._tree(f"{self.base}/run-{now['run']}", now["height"])):
            level.write.parquet(f"{at}/tree-{i}")
        self._publish(run, [run], now, now["height"])


def _ranges(leaf: DataFrame) -> list[tuple[int, int]]:
    """At most ``RANGES`` ranges that hold all nodes of ``leaf``: one for each node where they are few, else for each piece of the nodes' span."""
    low, high = leaf.agg(F.min("node"), F.max("node")).head()
    if low is None:
        return []
    width = max(1, -(-(high - low + 1) // RANGES))
    piece = _over(F.col("node") - low, width)
    found = sorted(tuple(r) for r in leaf.groupBy(piece.alias("p")).agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b").collect())
    joined: list[tuple[int, int]] = []
    for a, b in found:
        if joined and a == joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    return joined
