"""Operators on small inputs: nulls, ties, repeats, empty tables, wrong settings, and folds against step-by-step versions."""

import random
from collections import OrderedDict
from datetime import timedelta

import pytest
from conftest import LOG, START, uid
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.functions import envelope as E
from seqloom.functions.fnv import fnv1a64, partition_of
from seqloom.functions.ids import event_key_of, is_blank, uuid_key, uuid_text
from seqloom.operators import filters, folds, handlers, ordering, partitioning, positions, sinks, stateful, stores
from seqloom.operators.filters import EventFilter
from seqloom.operators.positions import InvalidCursor, Partitions, StartFrom, StopAt, Subscription


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def values(spark, kind, *xs):
    return spark.createDataFrame([(x,) for x in xs], f"x {kind}")


# ---- functions ----


def test_uuid_spellings(spark):
    good = [uid(5), uid(5).upper(), "{" + uid(5) + "}", "urn:uuid:" + uid(5), "URN:UUID:" + uid(5).upper(), uid(5).replace("-", ""), f"\t{uid(5)} \n"]
    bad = [None, "", "  ", "cmd-1", uid(5)[:-1], uid(5) + "0", "urn:" + uid(5)]
    got = [r[0] for r in values(spark, "string", *good, *bad).select(uuid_text(uuid_key(F.col("x")))).collect()]
    assert got == [uid(5)] * len(good) + [None] * len(bad)
    assert [r[0] is None for r in values(spark, "string", "cmd-1", " ", None).select(event_key_of(F.col("x"))).collect()] == [False, True, True]
    assert [r[0] for r in values(spark, "string", "a", " \t", None).select(is_blank(F.col("x"))).collect()] == [False, True, True]


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_fnv_vectors(spark):
    texts = ["order-123", "customer-7", "user-42", "", "é漢👍", "a\nb", "x" * 3000]
    df = values(spark, "string", *texts, None).select(fnv1a64(F.col("x")), partition_of(F.col("x"), 16), partition_of(F.col("x"), 7))
    got = [tuple(r) for r in df.collect()]
    assert [(h % 2**64, a, b) for h, a, b in got[:-1]] == [(fnv(t), fnv(t) % 16, fnv(t) % 7) for t in texts]
    assert got[-1] == (None, None, None)
    assert (fnv("order-123"), fnv("customer-7"), fnv("user-42") % 16) == (0x1B96F9C28B5D5ABA, 0x660308AB83C6FDF1, 11)


def test_namespaces(spark):
    df = values(spark, "string", "", "/", "a/b", "/a", "/a_b", "/ab", None)
    ns = E.namespace_of(F.col("x"))
    got = [tuple(r) for r in df.select(ns, E.namespace_parent(ns), E.namespace_depth(ns), E.namespace_within(ns, "/a"), E.namespace_scoped(ns, "/t")).collect()]
    assert got == [
        ("/", None, 0, False, "/t"), ("/", None, 0, False, "/t"), ("/a/b", "/a", 2, True, "/t/a/b"), ("/a", "/", 1, True, "/t/a"), ("/a_b", "/", 1, False, "/t/a_b"), ("/ab", "/", 1, False, "/t/ab"), (None, None, None, None, None),
    ]


def test_envelope_rules(spark, make_log):
    log = make_log({}, {"organization": "Acme"}, {"namespace": "//"}, {"topic": "a..b"}, {"event_key": ""}, {"event_key": "é" * 513}, {"content_type": "x"}, {"metadata": {".a": "1"}}, {"topic": None}, {"metadata": None})
    error = E.envelope_error(*(F.col(c) for c in ("organization", "namespace", "topic", "event_key", "content_type", "metadata")))
    assert [r[0] for r in log.orderBy("sequence").select(error).collect()] == [None, "organization", "namespace", "topic", "key", "key", "content_type", "metadata_key", "topic", None]


def test_cursor_bytes_and_times(spark):
    df = values(spark, "bigint", -5, 0, 3, 2**62)
    assert [bytes(r[0]) for r in df.select(E.order_bytes(F.col("x"))).collect()] == [(n + 2**63).to_bytes(8, "big") for n in (-5, 0, 3, 2**62)]
    back = values(spark, "string", "2031-03-01T01:02:03.000004Z", "soon", None).select(E.from_rfc3339(F.col("x")))
    assert [r[0] for r in back.collect()] == [START + timedelta(hours=1, minutes=2, seconds=3, microseconds=4), None, None]
    assert [r[0] for r in values(spark, "int", 1, 2, 4, 20).select(E.backoff_ms(F.col("x"))).collect()] == [100, 200, 800, 30_000]


# ---- ordering ----


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_numbers_and_running_greatest(spark, monkeypatch, block):
    monkeypatch.setattr(ordering, "BLOCK", block)
    r = random.Random(1)
    data = [(i * 2, r.choice("ab"), r.randrange(100)) for i in range(40)]
    df = spark.createDataFrame(data, "s bigint, k string, v int")
    assert [tuple(x)[-1] for x in ordering.numbered(df, "s").orderBy("s").collect()] == list(range(1, 41))
    want, seen, n, top = [], {}, {}, {}
    for s, k, v in data:
        n[k] = n.get(k, 0) + 1
        want.append((s, n[k], top.get(k)))
        top[k] = max(top.get(k, -1), v)
    both = ordering.greatest_before(ordering.numbered(df, "s", keys=("k",)), "s", "v", keys=("k",))
    assert rows(both.select("s", "rn", "before")) == sorted(want, key=repr)


# ---- positions and filters ----


def seqs(df):
    return sorted(r["sequence"] for r in df.collect())


def test_positions(spark, make_log):
    log = make_log(*({"organization": "a" if i % 2 else "b", "partition_id": i % 4, "partition_count": 4} for i in range(1, 9)), {"sequence": None})
    scan = lambda **kw: seqs(positions.scan(log, Subscription(**kw)))
    assert scan(start=StartFrom("earliest")) == list(range(1, 9))
    assert scan() == []
    assert seqs(positions.scan(log, Subscription(), as_of=5)) == [6, 7, 8]
    assert scan(start=StartFrom.after(2), stop=StopAt("cursor", 4)) == [3, 4]
    assert scan(start=StartFrom("earliest"), stop=StopAt("current_end"), filter=EventFilter(organization="a")) == [1, 3, 5, 7]
    assert scan(start=StartFrom("timestamp", str(START + timedelta(minutes=6)))) == [6, 7, 8]
    assert scan(start=StartFrom("earliest"), limit=2) == [1, 2]
    assert scan(start=StartFrom("earliest"), partitions=Partitions(4, [1, 3])) == [1, 3, 5, 7]
    assert scan(start=StartFrom("earliest"), partitions=Partitions(8, [1])) == []
    assert scan(start=StartFrom("earliest"), partitions=Partitions(4, [])) == []
    assert seqs(positions.scan(spark.createDataFrame([], LOG), Subscription(stop=StopAt("current_end")))) == []
    with pytest.raises(InvalidCursor):
        scan(start=StartFrom("yesterday"))


def test_strict_scan_ends_at_an_invalid_row(spark, make_log):
    log = make_log({}, {"topic": "No Topic"}, {"id": "x", "organization": "other"})
    sub = Subscription(StartFrom("earliest"), filter=EventFilter(organization="acme"))
    assert seqs(positions.scan(log, sub)) == [1, 2]
    for s, why in ((sub, "topic"), (Subscription(StartFrom.after(2)), "id")):
        with pytest.raises(PySparkException, match=f"no event, {why}"):
            positions.scan(log, s, strict=True).collect()
    assert seqs(positions.scan(log, Subscription(StartFrom("earliest"), StopAt("cursor", 1)), strict=True)) == [1]


def test_resume_seeds():
    sub = Subscription(StartFrom("earliest"))
    assert sub.with_starts([StartFrom.after(9), StartFrom.after(4), StartFrom("latest")]).start == StartFrom.after(4)
    assert sub.with_starts([StartFrom("latest")]).start == StartFrom("earliest")
    assert positions.compatible_start([(4, 9), (8, 2), (4, 5)], 4) == StartFrom.after(5)
    with pytest.raises(InvalidCursor):
        positions.compatible_start([(8, 2)], 4)
    both = positions.branch_starts([("left", StartFrom.after(3)), (None, StartFrom("earliest"))])
    assert both == {"left": [StartFrom.after(3), StartFrom("earliest")], "right": [StartFrom("earliest")]}
    assert Subscription(batch=5000).batch == 1000 and Subscription(batch=0).batch == 1


def test_filters(make_log):
    log = make_log({"namespace": "/a"}, {"namespace": "/a/b", "metadata": {"x": "1"}}, {"namespace": "/ab", "metadata": {"x": "2", "y": "1"}}, {"namespace": None, "metadata": None}, {"event_key": None, "topic": "t"})
    pick = lambda f: seqs(log.where(filters.column(f)))
    assert pick(EventFilter(namespace="/a")) == [1, 2]
    assert pick(EventFilter(namespace="/")) == [1, 2, 3, 5]
    assert pick(EventFilter(keys=[])) == []
    assert pick(EventFilter(keys=["k1", "k9"])) == [1]
    assert pick(EventFilter(metadata={"x": "2", "y": "1"})) == [3]
    assert pick(filters.negate(EventFilter(metadata={"x": "1"}))) == [1, 3, 4, 5]
    assert pick(filters.any_of()) == [] and pick(filters.all_of()) == [1, 2, 3, 4, 5]
    assert pick(filters.any_of(EventFilter(topic="t"), EventFilter(namespace="/ab"))) == [3, 5]
    assert pick(EventFilter(end_at=START + timedelta(minutes=2))) == [1, 2]


def test_filters_reach_the_scan(spark, make_log, tmp_path):
    make_log({}, {"topic": "t"}).write.parquet(f"{tmp_path}/log")
    df = positions.scan(spark.read.parquet(f"{tmp_path}/log"), Subscription(StartFrom.after(1), filter=EventFilter(topic="t", namespace="/x"))).select("sequence")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(sequence,1)" in plan and "EqualTo(topic,t)" in plan and "payload" not in plan


# ---- partitions ----


def test_partition_columns(spark, make_log):
    log = make_log({"event_key": "order-123"}, {"event_key": None}, {"partition_id": 3, "partition_count": 9})
    first = partitioning.stamped(log, F.col("event_key"), 64).orderBy("sequence").collect()
    assert (first[0]["partition_id"], first[0]["partition_strategy"]) == (fnv("order-123") % 64, "event_key:fnv1a64:v1")
    assert [first[1][c] for c in partitioning.STAMPS] == [None] * 5
    once = partitioning.backfilled(log, F.col("event_key"), 64)
    assert rows(partitioning.backfilled(once, F.col("event_key"), 64).select("sequence", "partition_id")) == rows(once.select("sequence", "partition_id"))
    assert rows(partitioning.backfill_report(log, 2)) == [(2, 1)]
    assert rows(partitioning.decoded(log).select("partition_id", "partition_count")) == [(0, 1), (0, 1), (3, 9)]
    with pytest.raises(PySparkException):
        partitioning.decoded(make_log({"partition_id": 1})).collect()
    with pytest.raises(ValueError):
        partitioning.stamped(log, F.col("event_key"), 0)
    with pytest.raises(ValueError):
        partitioning.backfill_report(log, 0)
    with pytest.raises(PySparkException):
        log.select(partitioning.by_metadata("region", strict=True)).collect()


def test_composite_key(make_log):
    log = make_log({"organization": "a", "event_key": "b"}, {"organization": None}, {"event_key": "x" * 1024})
    assert [r[0] for r in log.orderBy("sequence").select(partitioning.composite([F.col("organization"), F.col("event_key")])).collect()] == ["a:b", None, None]


def test_round_robin_is_the_scheduler(make_log):
    r = random.Random(3)
    lanes = [r.choice([0, 0, 1, 2]) for _ in range(50)]
    waiting = {k: [i for i, x in enumerate(lanes, 1) if x == k] for k in range(4)}
    order, last = [], 0
    while any(waiting.values()):
        last = next(k for k in [*range(last + 1, 4), *range(last + 1)] if waiting[k])
        order.append(waiting[last].pop(0))
    log = make_log(*({"partition_id": x} for x in lanes))
    got = partitioning.round_robin(log.select("sequence", "partition_id"), F.col("partition_id"), 4)
    assert [r["sequence"] for r in got.orderBy("position").collect()] == order


# ---- stateful ----


def test_against_store(spark, make_log):
    store = values(spark, "string", uid(1).upper(), "{" + uid(3) + "}", None).withColumnRenamed("x", "event_id")
    assert seqs(stateful.against_store(make_log({}, {}, {}, {"id": None}), store)) == [2, 4]


@pytest.mark.parametrize("keys", [[], ["organization"]])
def test_gate(spark, make_log, keys):
    r = random.Random(2)
    made = [{"timestamp": START + timedelta(minutes=r.randrange(40)), "organization": r.choice("ab")} for _ in range(60)]
    initial = None if not keys else spark.createDataFrame([("a", START + timedelta(minutes=10))], "organization string, watermark timestamp_ntz")
    mark, want = {"a": START + timedelta(minutes=10)} if keys else {}, []
    for i, row in enumerate(made, 1):
        k = row["organization"] if keys else ""
        if k not in mark or row["timestamp"] > mark[k]:
            mark[k] = row["timestamp"]
            want.append(i)
    assert seqs(stateful.monotone_gate(make_log(*made, {"sequence": 99, "timestamp": None}), keys=keys, initial=initial)) == want


def test_batches(make_log):
    got = stateful.batched(make_log(*[{}] * 7).select("sequence", "id"), 3)
    assert [(r["batch"], r["idx"]) for r in got.orderBy("sequence").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]
    assert rows(stateful.batch_cursors(got)) == [(0, uid(1), 3), (1, uid(4), 6), (2, uid(7), 7)]
    with pytest.raises(ValueError):
        stateful.settle_subset(got, 3, [3])
    with pytest.raises(ValueError):
        stateful.batched(got, 0)


@pytest.mark.parametrize(("nl", "nr", "weights"), [(7, 3, (1, 1)), (2, 9, (3, 2)), (5, 0, (2, 1)), (4, 4, None), (0, 3, (1, 2))])
def test_merges(spark, nl, nr, weights):
    left, right = [("l", i) for i in range(nl)], [("r", i) for i in range(nr)]
    order, a, b = [], list(left), list(right)
    while a or b:
        for side, n in ((a, weights[0] if weights else 10**6), (b, weights[1] if weights else 10**6)):
            for _ in range(n):
                if side:
                    order.append(side.pop(0))
    make = lambda x: spark.createDataFrame(x, "name string, sequence bigint")
    got = stateful.merged(make(left), make(right), weights).orderBy("position").collect()
    assert [(r["name"], r["sequence"]) for r in got] == order and [r["position"] for r in got] == list(range(1, nl + nr + 1))


def test_replay_then_live(make_log):
    history, live = make_log({}), make_log({"id": uid(1).upper()}, {"sequence": 2})
    assert [r["phase"] for r in stateful.replay_then_live(history, live).collect()] == ["replay", "live"]
    assert stateful.replay_then_live(history, live, dedupe=False).count() == 3


def test_expiry_and_routes(spark):
    t = lambda m: START + timedelta(minutes=m) if m is not None else None
    df = spark.createDataFrame([(t(0), t(5)), (t(0), t(11)), (t(0), None)], "delivered_at timestamp_ntz, acked_at timestamp_ntz")
    assert [r["expired"] for r in stateful.expired(df, "10 minutes").collect()] == [False, True, True]
    df = spark.createDataFrame([(True, True), (False, True), (True, False), (False, False)], "ok boolean, routed boolean")
    kinds = lambda **kw: [r["disposition"] for r in stateful.routed(df, F.col("ok"), F.col("routed"), **kw).collect()]
    assert kinds() == ["acked", "nacked", "route_failed", "route_failed"]
    assert kinds(ack_after_route=True) == ["acked", "acked", "route_failed", "route_failed"]
    assert kinds(require_route=False) == ["acked", "nacked", "acked", "nacked"]


def test_first_settlement_wins(spark):
    df = spark.createDataFrame([(1, 5, "nack"), (1, 3, "ack"), (2, 1, "nack"), (2, 1, "ack")], "k int, t int, outcome string")
    assert rows(stateful.settled_once(df, ["k"], "t", "outcome")) == [(1, "ack"), (2, "ack")]


# ---- folds ----


def run_fold(spark, values, start, out, kind="bigint"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values, 1)], f"sequence bigint, v {kind}")
    return [tuple(r)[1:] for r in folds.fold(df, {}, {"v": F.col("v")}, start, out).orderBy("sequence").collect()]


def test_windows(spark):
    assert run_fold(spark, [0, 1, 2, 50, 51, 90, 91], folds.windows(10, 40), {"w": "bigint"}) == [(0,), (0,), (0,), (1,), (1,), (1,), (2,)]
    assert run_fold(spark, [0] * 5, folds.windows(3, 10**7), {"w": "bigint"}) == [(0,), (0,), (0,), (1,), (1,)]


def test_bounded_memory(spark):
    r = random.Random(6)
    ids = [f"i{r.randrange(12)}" if r.randrange(9) else None for _ in range(200)]
    seen, want = OrderedDict(), []
    for x in ids:
        want.append((x not in seen,))
        if x is not None and x not in seen:
            seen[x] = 1
            if len(seen) > 5:
                seen.popitem(last=False)
    assert run_fold(spark, ids, folds.bounded_memory(5), {"delivered": "boolean"}, "string") == want


def test_packing_and_requests(spark):
    assert run_fold(spark, [4, 4, 4, 11, 10, 1], folds.batches(2, 10), {"b": "bigint"}) == [(0,), (0,), (1,), (-1,), (2,), (3,)]
    assert run_fold(spark, [3, 3, 5, 1], folds.grouped_requests(6), {"f": "bigint"}) == [(0,), (0,), (1,), (1,)]


def service(df, lanes, capacity, keys=()):
    got = folds.fold(df, {k: F.col(k) for k in keys}, {"v": F.col("v")}, folds.deepest_lane(lanes, capacity), {"served": "bigint", "lane": "int", "position": "bigint"}, many=True)
    return [(x["served"], x["lane"]) for x in got.orderBy(*keys, "position").collect()]


def test_depth_weighted_lanes(spark):
    df = spark.createDataFrame(list(enumerate([0, 1, 1, 0, 1, 2, 2, 1], 1)), "sequence bigint, v int")
    # row 5 finds lane 1 full: lane 0 keeps its turn until it is empty, then lane 1, the deepest, has its own; 8 waits for room once more
    assert service(df, 3, 2) == [(1, 0), (4, 0), (2, 1), (3, 1), (5, 1), (8, 1), (6, 2), (7, 2)]
    # of equals the first behind the last one served
    df = spark.createDataFrame(list(enumerate([2, 1, 0, 0, 2, 1], 1)), "sequence bigint, v int")
    assert service(df, 3, 9) == [(3, 0), (4, 0), (2, 1), (6, 1), (1, 2), (5, 2)]


def test_every_row_of_a_lane_is_served_once_and_in_order(spark):
    r = random.Random(3)
    data = [(i, "ab"[r.randrange(5) == 0], r.randrange(3)) for i in range(1, 301)]
    df = spark.createDataFrame(data, "sequence bigint, k string, v int").repartition(5)
    got = service(df, 3, 16, ("k",))
    assert sorted(got) == sorted((i, v) for i, _, v in data)
    for k in "ab":
        for lane in range(3):
            assert [i for i, v in got if v == lane and (i, k, v) in data] == [i for i, x, v in data if x == k and v == lane]


def test_folds_by_key_and_of_nothing(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(40)] + [(None, "a"), (7, None)], "sequence bigint, k string")
    got = folds.fold(df, {"k": F.col("k")}, {"v": F.col("sequence")}, folds.windows(2, 10**9), {"w": "bigint"})
    assert got.count() == 41
    assert {r["w"] for r in got.collect()} == set(range(10))
    assert folds.fold(df.where("false"), {"k": F.col("k")}, {"v": F.col("sequence")}, folds.windows(2, 9), {"w": "bigint"}).count() == 0
    assert folds.fold(df.where("false"), {}, {"v": F.lit(0)}, folds.deepest_lane(2, 3), {"served": "bigint", "lane": "int", "position": "bigint"}, many=True).count() == 0


def test_folds_go_over_whole_streams(spark):
    data = [(i, "ab"[i % 3 == 0], f"i{(i * i) % 23}") for i in range(80)]
    df = spark.createDataFrame(data, "sequence bigint, k string, v string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")  # streams span batches
    try:
        for make, kind, out, of in (
            (folds.bounded_memory(6), "string", "boolean", lambda v: v), (folds.batches(4, 12), "bigint", "bigint", lambda v: len(v) * 2), (folds.grouped_requests(25), "bigint", "bigint", len),
        ):
            steps = {k: make() for k in "ab"}
            want = [(k, i, *steps[k](i, of(v))) for i, k, v in data]
            value = F.col("v") if kind == "string" else (F.length("v") * (2 if of("xx") == 4 else 1)).cast("bigint")
            assert [tuple(r) for r in folds.fold(df, {"k": F.col("k")}, {"v": value}, make, {"o": out}).orderBy("sequence").collect()] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# ---- handlers ----


def test_attempts_and_states(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 9), ("d", None)], "k string, at int")
    states = {k: [r["state"] for r in handlers.attempts(df, F.col("at")).where(F.col("k") == k).orderBy("attempt").collect()] for k in "abcd"}
    assert states == {"a": ["ok"], "b": ["retry", "retry", "ok"], "c": ["retry", "retry", "dead_letter"], "d": ["retry", "retry", "dead_letter"]}
    assert rows(handlers.final_state(df, F.col("at")).select("k", "attempts", "state")) == [("a", 1, "ok"), ("b", 3, "ok"), ("c", 3, "dead_letter"), ("d", 3, "dead_letter")]
    with pytest.raises(ValueError):
        handlers.attempts(df, F.col("at"), 0)


def test_outcomes(spark):
    df = spark.createDataFrame([(True, 5), (False, 5), (None, 5), (True, 50)], "ok boolean, ms int")
    assert [r["outcome"] for r in handlers.handled(df, F.col("ok"), duration_ms=F.col("ms"), timeout_ms=10).collect()] == ["ok", "error", "error", "timeout"]
    assert [r["outcome"] for r in handlers.handled(df, F.col("ok"), only=F.col("ms") > 10).collect()] == ["ok"] * 4


def test_dead_letters(make_log):
    made = handlers.dead_letters(make_log({"correlation_id": "c", "causation_id": "x", "metadata": {"a": "b"}}), "h", F.lit(3), F.lit("bad"), F.col("timestamp")).collect()[0]
    assert (made["topic"], made["parent_id"], made["correlation_id"], made["causation_id"], made["metadata"]) == ("thing.happened.dead_letter", uid(1), "c", None, {})
    assert '"original_event_id":"' + uid(1) in made["payload"] and '"attempts":3' in made["payload"]


def test_policies(spark, make_log):
    log = make_log({"content_type": "a"}, {"content_type": "b"}, {"content_type": "c"}, {"content_type": None})
    policy = F.when(F.col("content_type") == "a", "skip").when(F.col("content_type") == "b", "dead_letter")
    assert rows(handlers.attempts(log, F.lit(2), 3, policy).select("sequence", "attempt", "state")) == [(1, 1, "skip"), (2, 1, "dead_letter"), (3, 1, "retry"), (3, 2, "ok"), (4, 1, "retry"), (4, 2, "ok")]
    good = F.when(F.col("sequence") > 2, F.col("content_type") == "c")
    for kind, want in (("surface", None), ("ack", "ack"), ("nack", "nack")):
        assert rows(handlers.decoded(log, good, kind).select("sequence", "readable", "settlement")) == sorted([(1, False, want), (2, False, want), (3, True, None), (4, False, want)], key=repr)
    for wrong in (lambda: handlers.decoded(log, good, "drop"), lambda: handlers.unmatched_outcome(log, [], "skip")):
        with pytest.raises(ValueError):
            wrong()
    assert [r["outcome"] for r in handlers.unmatched_outcome(log, [], "error").collect()] == ["handler_error"] * 4


def test_encoded_cursors(spark):
    df = values(spark, "bigint", 5, -1, 2**62)
    coded = df.withColumn("c", E.encoded_cursor(F.lit("global"), F.lit("log"), F.col("x")))
    assert all(a == b for a, b in coded.select("x", E.decoded_cursor(F.col("c"), "log")).collect())
    assert coded.select(E.decoded_cursor(F.col("c"), "kafka").alias("p"), E.cursor_error(F.col("c"), "kafka").alias("e")).distinct().collect() == [(None, "expected cursor kind kafka, got log")]
    broken = values(spark, "string", "e30=", "!", None).select(F.struct(F.lit("log").alias("kind"), F.col("x").alias("payload")).alias("c"))
    assert [r[0] for r in broken.select(E.cursor_error(F.col("c"), "log")).collect()] == ["cursor payload is unreadable"] * 3


def test_flushes_permits_and_waits(spark):
    df = spark.createDataFrame([(1, 5, 0), (2, 9, 10), (3, 7, 20), (4, 8, 30), (5, 1, 99), (6, 2, 100)], "sequence bigint, p bigint, us bigint")
    made = folds.fold(df, {}, {"p": F.col("p"), "us": F.col("us")}, folds.flushes(3, 50), {"position": "bigint", "cause": "string"}, many=True)
    assert rows(made.select("position", "cause")) == [(2, "end"), (8, "interval"), (9, "count")]
    assert run_fold(spark, [1, 1, 1, 1], folds.grouped_requests(3), {"f": "bigint"}) == [(0,), (0,), (0,), (1,)]
    two = folds.fold(df, {}, {"us": F.col("us"), "t": F.lit(25).cast("bigint")}, folds.permits(2), {"at": "bigint"}).orderBy("sequence")
    assert [r["at"] for r in two.collect()] == [0, 10, 25, 35, 99, 100]
    waits = folds.fold(df, {}, {"n": F.lit(1).cast("bigint"), "us": F.col("us")}, folds.grouped_requests(100, 15), {"f": "bigint"}).orderBy("sequence")
    assert [r["f"] for r in waits.collect()] == [0, 0, 1, 1, 2, 2]


def test_jams_and_pending(spark, make_log):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0, 1, 0, 1, 0, 1], 1)] + [(None, 0)], "sequence bigint, lane int")
    assert rows(partitioning.jams(df, "lane", 2, 2)) == [(5, True)]
    assert rows(partitioning.jams(df, "lane", 3, 2)) == [(5, False)] and rows(partitioning.jams(df, "lane", 2, 3)) == [(None, False)]
    assert rows(stores.pending_stops(df, F.col("sequence") < 3, ["lane"], 1)) == [(0, 3, 2, 5), (1, 4, 2, 6)]
    assert rows(stores.pending_stops(df, F.lit(True), ["lane"], 1)) == []
    with pytest.raises(Exception, match="invalid cursor"):
        partitioning.lane_of_partition(make_log({"partition_id": 1, "partition_count": 32}), 64).collect()


def test_multiplexer(spark, make_log):
    routes = [handlers.Route("a", EventFilter(topic="t")), handlers.Route("b", EventFilter(organization="acme"))]
    log = make_log({"topic": "t"}, {"organization": "x"}, {"organization": None})
    made = handlers.multiplexed(log, routes)
    assert rows(made.select("sequence", "subscriber_id")) == [(1, "a"), (1, "b")]
    assert seqs(handlers.unmatched(log, routes)) == [2, 3]
    done = spark.createDataFrame([(uid(1).upper(), "a"), (None, "b")], "event_id string, subscriber_id string")
    assert rows(handlers.remaining(made, done).select("subscriber_id")) == [("b",)]
    assert rows(handlers.acknowledged(made, F.col("subscriber_id") == "a")) == [(1, 2, 1, False)]
    with pytest.raises(ValueError):
        handlers.matching([routes[0], routes[0]])


# ---- stores ----


def test_contiguous_and_flushes(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "a", None), (4, "a", True), (5, "b", False), (6, "c", True)], "sequence bigint, k string, ok boolean")
    assert rows(stores.contiguous(df, F.col("ok"), ["k"])) == [("a", 2), ("b", None), ("c", 6)]
    assert rows(stores.flush_points(df, 2, ["k"])) == [("a", 1, 2), ("a", 2, 4)]


def test_remaining_counts(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 5)
    log = values(spark, "bigint", *range(3, 40), None).withColumnRenamed("x", "sequence")
    marks = spark.createDataFrame([("g", "a", 0), ("g", "b", 17), ("g", "c", 39), ("g", "d", 24), ("g", "e", None), ("g", "f", 500)], "consumer_group_id string, stream_id string, at bigint")
    assert rows(stores.remaining_counts(log, marks, "at")) == [("g", "a", 37, 3), ("g", "b", 22, 18), ("g", "d", 15, 25)]


def test_claims(spark):
    df = spark.createDataFrame([(1, "a", None, 0), (2, "a", START, 2), (3, "a", START + timedelta(days=9), 0), (4, "b", None, 0)], "id bigint, who string, claimed_until timestamp_ntz, attempts int")
    now = str(START + timedelta(days=1))
    assert rows(stores.claim(df, now, 2).select("id", "attempts")) == [(1, 1), (2, 3)]
    assert rows(stores.claim(df, now, 1, per=["who"]).select("id")) == [(1,), (4,)]


LEASES = "consumer_group_id string, stream_id string, partition_id int, owner_id string, lease_until timestamp_ntz, generation bigint, checkpoint_sequence bigint"


def test_leases(spark):
    over, held = START - timedelta(1), START + timedelta(1)
    df = spark.createDataFrame([("g", "s", 0, "a", held, 1, 5), ("g", "s", 1, "a", held, 2, 0), ("g", "s", 2, "a", over, 1, 7), ("g", "s", 3, "b", held, 1, 9), ("g", "s", 4, None, None, 3, None)], LEASES)
    assert [r[0] for r in df.select(stores.lease_open("b", str(START))).collect()] == [False, False, True, True, True]
    assert rows(stores.releases(df.where("partition_id < 4"))) == [("g", "s", "a", 2)]
    assert rows(stores.next_claims(df, "b", str(START), 2)) == [("g", "s", 2), ("g", "s", 4)]
    assert rows(stores.shared_start(df)) == [("g", "s", 0)]
    assert rows(stores.shared_start(df.where("partition_id in (0, 2)"))) == [("g", "s", 5)]
    said = spark.createDataFrame([("g", "s", 0, "a", 1, 3), ("g", "s", 1, "a", 1, 99), ("g", "s", 2, "a", 1, 9), ("g", "s", 4, "b", 3, 1)], "consumer_group_id string, stream_id string, partition_id int, owner_id string, generation bigint, position bigint")
    assert rows(stores.fenced(df, said).select("partition_id", "accepted", "checkpoint_after")) == [(0, True, 5), (1, False, 0), (2, True, 9), (4, False, None)]


# ---- sinks and the wire ----


def test_wire_round_trip(spark, make_log):
    log = make_log({"payload": '{"b":1,"a":"é\\"\\n"}', "metadata": {"z": "1", "a": "2"}, "correlation_id": "c"}, {"payload": "plain   text", "content_type": "text/plain"}, {"payload": None})
    texts = log.select("sequence", sinks.wire().alias("value"))
    one = {r["sequence"]: r["value"] for r in texts.collect()}
    assert one[1].startswith('{"id":"' + uid(1)) and '"metadata":{"a":"2","z":"1"}' in one[1] and '"parent_id":null' in one[1] and '"data":{"a"' in one[1]
    back = sinks.unwire(texts).orderBy("sequence").collect()
    assert [r["readable"] for r in back] == [True, True, True]
    assert back[1]["event"]["payload"]["data"] == "plain   text" and back[0]["event"]["timestamp"] == "2031-03-01T00:01:00.000000Z"
    poison = values(spark, "string", None, "", "{", "[]", '{"id":"x"}', "null").withColumnRenamed("x", "value")
    assert not any(r["readable"] for r in sinks.unwire(poison).collect())


def test_append_numbers_on(make_log):
    log = make_log({}, {})
    new = make_log({"sequence": 1, "id": uid(2).upper()}, {"sequence": 2, "id": uid(8)}, {"sequence": 3, "id": uid(9)}, {"sequence": 4, "id": uid(8)})
    assert rows(sinks.appended(log, new.select("id", F.col("sequence").alias("o")), "o").select("id", "sequence")) == [(uid(8), 3), (uid(9), 4)]


def test_writers(spark, make_log):
    log = make_log({"version": 1}, {"version": None})
    with pytest.raises(PySparkException):
        sinks.mapped(log, {}, valid=F.col("version") > 0).collect()
    assert sinks.flat_mapped(log, F.when(F.col("version") == 1, F.array(F.lit(1), F.lit(2))), "x").count() == 2
    assert sinks.fanned_out(log, ["a", "b"]).count() == 4
    with pytest.raises(ValueError):
        sinks.fanned_out(log, [])
    waits, fails = [], iter([True, True, False])

    def write():
        if next(fails):
            raise OSError

    assert sinks.write_with_retry(write, sleep=waits.append) == 3 and waits == [0.1, 0.2]
    with pytest.raises(OSError):
        sinks.write_with_retry(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)


def test_strict_reading_ends_at_poison(spark):
    poison = values(spark, "string", "{").withColumnRenamed("x", "value")
    with pytest.raises(PySparkException):
        sinks.unwire(poison, strict=True).collect()


def test_lanes_are_handled_in_order(spark):
    r = random.Random(8)
    data = [(i, i % 3) for i in range(200)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "sequence bigint, lane bigint").repartition(5)

    def handle(batches):
        last = {}
        for b in batches:
            for lane, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                assert last.get(lane, -1) < n
                last[lane] = n
            yield b

    assert partitioning.in_lane_order(df, "lane", handle, "lane bigint, sequence bigint").count() == 200


def test_snapshots(spark):
    df = spark.createDataFrame([(1, "a", "x"), (3, "a", None), (2, "a", "y"), (None, "a", "z"), (5, None, "n")], "sequence bigint, k string, s string")
    assert rows(stores.snapshots(df, ["k"], ["s"])) == [("a", None, 3), (None, "n", 5)]


def test_schemas_and_collected_events(spark):
    from seqloom.sources import model

    assert model.create_table_sql("dedupe", "state.seen").startswith("create table if not exists `state`.`seen` (event_id string")
    with pytest.raises(ValueError):
        model.create_table_sql("dedupe", "a b")
    got = model.collected(spark, [{"sequence": 1, "metadata": {"a": "b"}}])
    assert got.head()["metadata"] == {"a": "b"} and got.schema == spark.createDataFrame([], LOG).schema
    assert not model.SOURCES["queue"].cursor and model.SOURCES["log"].start_after
