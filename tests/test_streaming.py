"""Streams equal batches, restarts repeat nothing, and the control plane fences its owners."""

import os
import shutil
import time
from datetime import timedelta

import pandas as pd
import pytest
from conftest import START, uid
from pyspark.sql import functions as F

from seqloom.operators import sinks, stateful
from seqloom.operators.filters import EventFilter
from seqloom.operators.positions import InvalidCursor, Partitions, StartFrom
from seqloom.sources import brokers
from seqloom.sources.model import Duplex
from seqloom.streaming import runner
from seqloom.streaming.source import LogSource, LogStream
from seqloom.streaming.state import ConfigError, Coordinator, OwnershipLost, Store

SHORT = "sequence bigint, id string, organization string, topic string, timestamp timestamp_ntz"


def part(spark, folder, numbers, name):
    data = [(n, uid(n), f"o{n % 3}", "bad" if n % 4 == 0 else "good", START + timedelta(minutes=(n * 7) % 50)) for n in numbers]
    spark.createDataFrame(data, SHORT).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


@pytest.fixture
def folder(spark, tmp_path):
    at = f"{tmp_path}/in"
    os.makedirs(at)
    part(spark, at, range(1, 21), "a")
    part(spark, at, range(15, 41), "b")
    return at


def merged_files(folder):
    """All part files in one directory, as a file stream reads it."""
    flat = f"{folder}-flat"
    os.makedirs(flat, exist_ok=True)
    for root, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".parquet"):
                shutil.copy(f"{root}/{n}", f"{flat}/{os.path.basename(root)}-{n}")
    return flat


def test_consumer_routes_and_resumes(spark, folder, tmp_path):
    flat = merged_files(folder)
    make = lambda: runner.Consumer(
        runner.file_stream(spark, flat, SHORT, files_per_trigger=1), lambda: runner.ok_if(F.col("topic") == "good"), f"{tmp_path}/out", f"{tmp_path}/state"
    )
    make().start(until_end=True).awaitTermination()
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert (read("ok").count(), read("error").count()) == (34, 12)
    make().start(until_end=True).awaitTermination()  # nothing new, nothing twice
    assert read("ok").count() == 34
    part(spark, folder, range(41, 45), "c")
    merged_files(folder)
    make().start(until_end=True).awaitTermination()
    assert (read("ok").count(), read("error").count()) == (37, 13)


def test_a_repeated_batch_replaces_its_output(spark, folder, tmp_path):
    consumer = runner.Consumer(None, lambda: runner.ok_if(F.col("topic") == "good"), f"{tmp_path}/out", f"{tmp_path}/state")
    batch = spark.read.schema(SHORT).parquet(f"{folder}/a")
    for _ in range(2):
        consumer.handle(batch, 7)
    assert spark.read.parquet(f"{tmp_path}/out/ok").count() == 15


def test_every_outcome_is_written(spark, folder, tmp_path):
    kinds = F.when(F.col("sequence") % 3 == 0, "parked").when(F.col("sequence") % 3 == 1, F.lit(None)).otherwise("ok")
    consumer = runner.Consumer(None, lambda: kinds, f"{tmp_path}/out", f"{tmp_path}/state")
    consumer.handle(spark.read.schema(SHORT).parquet(f"{folder}/a"), 1)
    assert {n: spark.read.parquet(f"{tmp_path}/out/{n}").count() for n in ("ok", "error", "parked")} == {"ok": 7, "error": 7, "parked": 6} == consumer.counts
    with pytest.raises(ValueError):
        runner.Consumer(None, lambda: F.lit("../x"), f"{tmp_path}/out", f"{tmp_path}/state").handle(spark.read.schema(SHORT).parquet(f"{folder}/a"), 2)


def collected(stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_stream_dedupe_equals_batch(spark, folder, tmp_path):
    flat = merged_files(folder)
    got = collected(runner.deduplicated(runner.file_stream(spark, flat, SHORT)), tmp_path, "once")
    assert sorted(r["sequence"] for r in got.collect()) == list(range(1, 41))


def test_stream_gate_equals_batch(spark, folder, tmp_path):
    flat = merged_files(folder)
    os.remove(next(f"{flat}/{n}" for n in os.listdir(flat) if n.startswith("b")))
    got = collected(runner.monotone_gate(runner.file_stream(spark, flat, SHORT), "organization"), tmp_path, "gate")
    want = stateful.monotone_gate(spark.read.parquet(flat), keys=["organization"])
    assert sorted(r["sequence"] for r in got.collect()) == sorted(r["sequence"] for r in want.collect())


def test_stream_period_counts(spark, folder, tmp_path):
    got = collected(runner.period_counts(runner.file_stream(spark, merged_files(folder), SHORT), period="1 hour"), tmp_path, "periods", "complete")
    assert sum(r["n"] for r in got.collect()) == 46


def test_supervised_restarts_and_gives_up(spark, folder, tmp_path):
    flat, waits, tries = merged_files(folder), [], iter([1, 1, 0])

    def outcome():
        return F.raise_error(F.lit("no")).cast("string") if next(tries) else runner.ok_if(F.col("topic") == "good")

    make = lambda o: runner.Consumer(runner.file_stream(spark, flat, SHORT), o, f"{tmp_path}/out", f"{tmp_path}/state").start(until_end=True)
    assert runner.supervised(lambda: make(outcome), sleep=waits.append) == 2 and waits == [0.1, 0.2]
    assert spark.read.parquet(f"{tmp_path}/out/ok").count() == 34
    bad = lambda: runner.Consumer(runner.file_stream(spark, flat, SHORT), lambda: F.raise_error(F.lit("no")).cast("string"), f"{tmp_path}/o2", f"{tmp_path}/s2").start(until_end=True)
    with pytest.raises(Exception):  # noqa: B017
        runner.supervised(bad, retries=1, sleep=waits.append)


def test_inspection(spark):
    df, seen = runner.inspected(spark.range(10), even=F.col("id") % 2 == 0)
    assert df.count() == 10 and seen.get == {"seen": 10, "even": 5}


def test_log_source_offsets(spark, data, tmp_path):
    spark.dataSource.register(LogSource)
    path = f"{data}/event_log.parquet"
    stored = spark.read.parquet(path)
    end = stored.agg(F.max("sequence")).head()[0]
    batch = spark.read.format("seqloom_log").option("path", path).option("after", 400).option("range", 97).load()
    assert batch.count() == stored.where("sequence > 400").count()
    stream = spark.readStream.format("seqloom_log").option("path", path).option("after", end - 50).load().select("sequence", "topic")
    assert collected(stream, tmp_path, "live").count() == stored.where(F.col("sequence") > end - 50).count()
    source = LogStream({"path": path, "latest": "true"})
    assert source.initialOffset() == source.latestOffset() == {"sequence": end}


def test_the_stream_takes_every_filter_of_the_table(spark, data, tmp_path):
    spark.dataSource.register(LogSource)
    path = f"{data}/event_log.parquet"
    stored = spark.read.parquet(path)
    live = spark.readStream.format("seqloom_log").option("path", path).option("range", 300).load()
    assert {c: t for c, t in live.dtypes} == {c: t for c, t in stored.dtypes}
    one = stored.where("partition_id is not null").orderBy("sequence").head()
    for n, sub in enumerate((
        EventFilter(organization=one["organization"], topic=one["topic"]), EventFilter(namespace="/shop"), EventFilter(keys=[one["event_key"], "none"]), EventFilter(metadata={"producer": one["metadata"]["producer"]}),
        EventFilter(end_at="2031-03-10 00:00:00"), Partitions(64, [one["partition_id"], 3]),
    )):
        got = collected(live.where(sub.column()), tmp_path, f"live{n}")
        assert sorted(map(repr, got.drop("metadata").collect())) == sorted(map(repr, stored.where(sub.column()).select(*live.columns).drop("metadata").collect())) and got.count()


def test_log_files_are_pruned_and_batches_limited(spark, tmp_path, make_log, monkeypatch):
    path = f"{tmp_path}/log"
    add = lambda low, high: make_log(*({"sequence": i} for i in range(low, high))).coalesce(1).write.mode("append").parquet(path)
    add(1, 51)
    add(51, 101)
    source = LogStream({"path": path, "range": "20", "most": "30"})
    assert source.initialOffset() == {"sequence": 0} and [source.latestOffset()["sequence"] for _ in range(5)] == [30, 60, 90, 100, 100]
    parts = source.partitions({"sequence": 0}, {"sequence": 100})
    assert [(p.low, p.high, len(p.files)) for p in parts] == [(0, 20, 1), (20, 40, 1), (40, 60, 2), (60, 80, 1), (80, 100, 1)]
    assert sum(b.num_rows for p in parts for b in source.read(p)) == 100
    monkeypatch.setattr("seqloom.streaming.source.MOST_TASKS", 2)
    assert [(p.low, p.high) for p in source.partitions({"sequence": 0}, {"sequence": 100})] == [(0, 50), (50, 100)]
    add(90, 95)
    with pytest.raises(ValueError, match="handed out"):
        source.latestOffset()
    spark.dataSource.register(LogSource)
    live = spark.readStream.format("seqloom_log").option("path", path).option("most", 40).load().select("sequence")
    assert collected(live, tmp_path, "limited").count() == 105


def test_stream_dedupe_takes_spellings_for_one_id(spark, tmp_path):
    data = [(1, uid(1), "o", "t", START), (2, uid(1).upper(), "o", "t", START), (3, None, "o", "t", START), (4, None, "o", "t", START), (5, "{" + uid(2) + "}", "o", "t", START), (6, uid(2), "o", "t", START)]
    spark.createDataFrame(data, SHORT).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = collected(runner.deduplicated(runner.file_stream(spark, f"{tmp_path}/in", SHORT)), tmp_path, "spellings")
    assert sorted(r["sequence"] for r in got.collect()) == [1, 3, 4, 5]


def test_memory_sink_and_time_limit(spark, folder, tmp_path):
    query = sinks.memory_sink(runner.file_stream(spark, merged_files(folder), SHORT), "kept", f"{tmp_path}/kept")
    query.awaitTermination()
    assert spark.table("kept").count() == 46
    done = []
    sinks.write_with_timeout(spark, lambda: done.append(spark.range(5).count()), 60)
    assert done == [5]
    slow = spark.range(4).repartition(4).mapInPandas(lambda parts: (time.sleep(30) or p for p in parts), "id bigint")
    with pytest.raises(TimeoutError):
        sinks.write_with_timeout(spark, lambda: slow.write.format("noop").mode("overwrite").save(), 1)

    def broken():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        sinks.write_with_timeout(spark, broken, 60)


# ---- control plane ----


def test_checkpoints_only_grow():
    s = Store()
    s.commit("g", "s", "global", 9)
    s.commit("g", "s", "global", 4)
    s.commit("g", "s", "partition:2:1", 3)
    assert s.positions("g", "s") == {"global": 9, "partition:2:1": 3} and s.start("g", "s") == 3
    assert s.start("g", "other") is None
    with pytest.raises(ConfigError):
        s.start("g", "other", missing="error")


def test_marks_and_watermarks():
    s = Store(prefix="x_")
    assert s.mark("e", 1) and not s.mark("e", 2)
    s.save_watermark("k", 9, 1)
    s.save_watermark("k", 5, 2)
    assert s.watermark("k") == 5 and s.watermark("none") is None
    s.complete("e", "a", 1)
    s.complete("e", "a", 2)
    assert s.completed("e", "a") and not s.completed("e", "b")
    with pytest.raises(ConfigError):
        Store(prefix="a;b")


def test_work_queue():
    s = Store()
    ids = [s.enqueue("a", f"e{i}") for i in range(3)] + [s.enqueue("b", "x")]
    assert [w[0] for w in s.claim_work("a", 2, now=0, lease=10)] == ids[:2]
    assert [w[0] for w in s.claim_work("a", 5, now=5, lease=10)] == [ids[2]]
    s.settle_work(ids[0], ok=True)
    s.settle_work(ids[1], ok=False)
    assert s.claim_work("a", 5, now=6, lease=1) == [(ids[1], "e1", 2)]
    assert [w[0] for w in s.claim_work("a", 5, now=99, lease=1)] == [ids[1], ids[2]]


def test_leases_are_fenced():
    s = Store()
    first = s.claim("g", "s", 0, 4, "a", now=0)
    assert first.generation == 1 and first.checkpoint is None
    assert s.claim("g", "s", 0, 4, "b", now=30) is None
    with pytest.raises(ConfigError):
        s.claim("g", "s", 0, 8, "a", now=1)
    s.checkpoint("g", "s", first, 12)
    s.checkpoint("g", "s", first, 5)
    second = s.claim("g", "s", 0, 4, "b", now=61)
    assert (second.generation, second.checkpoint) == (2, 12)
    for call in (lambda: s.renew("g", "s", first, 62), lambda: s.release("g", "s", first), lambda: s.checkpoint("g", "s", first, 99)):
        with pytest.raises(OwnershipLost):
            call()
    s.release("g", "s", second)
    assert s.claim("g", "s", 0, 4, "a", now=63).generation == 4


def test_coordinators_share_partitions():
    s = Store()
    a, b = (Coordinator(s, "g", "s", o, 5) for o in "ab")
    assert a.step(0) == [0, 1, 2, 3, 4]
    assert b.step(1) == []
    assert a.step(2) == [0, 1, 2]
    assert b.step(3) == [3, 4]
    for n, lease in a.leases.items():
        s.checkpoint("g", "s", lease, 10 + n)
    assert a.start() is None  # claimed before there was a checkpoint
    assert b.step(200) == [0, 1, 2, 3, 4] and a.step(201) == []  # a's leases ran out, then it finds them lost


def test_coordinators_keep_acks_back_and_flush_on_release():
    s, seen = Store(), []
    a = Coordinator(s, "g", "s", "a", 4, flush_acks=3, flush_s=10, changed=seen.append)
    a.step(0)
    assert [a.ack(3, p, t) for p, t in ((5, 0), (9, 1), (7, 2), (8, 3), (11, 14), (20, 15))] == [False, False, True, False, True, False]
    assert s.claim("g", "s", 3, 4, "a", 16).checkpoint == 11
    with pytest.raises(OwnershipLost):
        a.ack(9, 1, 0)
    a = Coordinator(s, "h", "s", "a", 4, flush_acks=9, changed=seen.append)
    a.step(0)
    a.ack(3, 20, 1)
    b = Coordinator(s, "h", "s", "b", 4)
    b.step(1)
    assert a.step(2) == [0, 1] and b.step(3) == [2, 3]  # what waited was flushed before the partition went over
    assert b.leases[3].checkpoint == 20 and seen == [[0, 1, 2, 3], [0, 1, 2, 3], [0, 1]]
    a.ack(0, 4, 5)
    a.shut_down()
    assert a.leases == {} and s.claim("h", "s", 0, 4, "b", 6).checkpoint == 4
    assert [Coordinator.pause(10, x) for x in (0, 1)] == [10, 12]


# ---- brokers ----


def test_kafka_options():
    base = lambda start, n=1: brokers.kafka_options("h:1", "t", start, n)
    assert base(StartFrom("earliest"))["startingOffsets"] == "earliest"
    assert base(StartFrom("timestamp", 5))["startingTimestamp"] == "5"
    assert base(StartFrom.after(7), 2)["startingOffsets"] == '{"t": {"0": 8, "1": 8}}'
    with pytest.raises(InvalidCursor):
        base(StartFrom("never"))


def test_readable_bodies(spark, make_log):
    records = brokers.kafka_records(make_log({}, {"payload": "x", "content_type": "text/plain"})).select("value")
    bodies = records.unionByName(spark.createDataFrame([(None,), ("{",)], "value string"))
    assert brokers.readable(bodies).count() == 2


class Queue:
    def __init__(self, bodies=()):
        self.bodies, self.deleted, self.released, self.sent = [(str(i), b) for i, b in enumerate(bodies)], [], [], []

    def receive(self, most, wait_s):
        out, self.bodies = self.bodies[:most], self.bodies[most:]
        return out

    def delete(self, handles):
        self.deleted += handles
        return []

    def release(self, handles):
        self.released += handles
        return handles[:1] if "bad" in handles else []

    def send(self, bodies):
        self.sent.append(bodies)
        return []


def test_queue_reader_skips_poison():
    queue = Queue(["1", "x", "3", "4"])
    reader = brokers.QueueReader(queue, int, wait_s=99)
    assert reader.wait_s == 20
    assert list(reader.read(limit=3)) == [("0", 1), ("2", 3), ("3", 4)] and queue.deleted == ["1"]
    reader.settle([str(i) for i in range(12)], ["a"])
    assert len(queue.deleted) == 13 and queue.released == ["a"]
    with pytest.raises(RuntimeError):
        reader.settle([], ["bad"])


def test_queue_reader_goes_on_after_empty_and_failed_polls():
    queue, polls, waits = Queue([]), iter([[("a", "1")], OSError("gone"), [], [("b", "2")], [], [], [("c", "3")]]), []

    def receive(most, wait_s):
        found = next(polls)
        if isinstance(found, Exception):
            raise found
        return found

    queue.receive = receive
    reader = brokers.QueueReader(queue, int, sleep=waits.append)
    assert list(reader.read(polls=2)) == [("a", 1), ("b", 2)] and waits == [1.0]
    given = reader.read()
    assert next(given) == ("c", 3)
    reader.stop()
    assert list(given) == []


def test_queue_as_a_stream():
    brokers.test_queue = Queue(["x", "y", "z"])
    brokers.test_client = lambda: brokers.test_queue
    source = brokers.QueueStream({"client": "seqloom.sources.brokers:test_client", "most": "2"})
    rows, end = source.read(source.initialOffset())
    assert list(rows) == [("0", "x"), ("1", "y")] and brokers.test_queue.deleted == []
    source.commit(end)
    rows, end = source.read(end)
    assert list(rows) == [("2", "z")] and brokers.test_queue.deleted == ["0", "1"]
    rows, last = source.read(end)
    assert list(rows) == [] and last == end
    del brokers.test_queue, brokers.test_client


def test_duplex(spark, make_log, tmp_path):
    both = Duplex(lambda df: df.write.mode("append").parquet(f"{tmp_path}/d"), lambda: spark.read.parquet(f"{tmp_path}/d"))
    both.write(make_log({}, {}))
    assert both.read().count() == 2


def test_queue_writer_batches():
    queue = Queue()
    write = brokers.queue_writer(lambda: queue)
    bodies = ["x" * 100_000] * 5 + ["y"] * 12
    assert [p["sent"].tolist() for p in write(iter([pd.DataFrame({"value": bodies})]))] == [[17]]
    assert [len(b) for b in queue.sent] == [2, 2, 10, 3] and all(sum(map(len, b)) <= brokers.MOST_BYTES for b in queue.sent)
    with pytest.raises(ValueError):
        list(write(iter([pd.DataFrame({"value": ["z" * 300_000]})])))
