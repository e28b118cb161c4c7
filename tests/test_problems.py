"""The data-processing operators against plain computations on small inputs, with nulls, ties, repeats and empty tables."""

import base64
import itertools
import json
import random
from datetime import timedelta

import pytest
from conftest import LOG, START, uid
from pyspark.sql import functions as F

from seqloom.operators import heavy_keys, hierarchy, incremental, late_events, lookup, orphans, schema_drift


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- late events ----


def marks(spark, *found):
    return spark.createDataFrame([(k, START + timedelta(minutes=m), START + timedelta(minutes=u)) for k, m, u in found], "key string, ts timestamp_ntz, updated_at timestamp_ntz")


def test_late_rows_by_frontier_and_watermark(spark, make_log):
    at = lambda m: {"timestamp": START + timedelta(minutes=m)}
    log = make_log(at(10), at(130), at(20), at(125), at(15), at(15) | {"organization": "other"})
    saved = marks(spark, ("acme@4", 15, 1), ("acme@4", 900, 0), ("left:acme@1", 900, 1), ("acme/x@1", 900, 1))
    # row 3 is late for its hour; row 5 equals the valid watermark saved after row 4; the older save under the same key is not valid
    assert rows(late_events.late_rows(log, saved)) == [(3, "corrected"), (5, "dropped")]


def test_late_rows_redelivery_and_duplicates_count_once(spark, make_log):
    log = make_log({"timestamp": START + timedelta(hours=3)}, {"timestamp": START}, {"sequence": 3, "id": uid(2).upper(), "timestamp": START + timedelta(hours=1)}, {"sequence": 2, "id": uid(2), "timestamp": START})
    assert rows(late_events.late_rows(log, marks(spark))) == [(2, "corrected")]


def test_late_rows_across_blocks(spark, make_log, monkeypatch):
    monkeypatch.setattr(late_events, "BLOCK", 4)
    r = random.Random(3)
    times = [r.randrange(600) for _ in range(60)]
    log = make_log(*({"timestamp": START + timedelta(minutes=m)} for m in times))
    saved = [(f"acme@{s}", r.randrange(400), 1) for s in range(5, 60, 7)]
    want = []
    for i, m in enumerate(times, 1):
        cut = max((t for k, t, _ in saved if int(k.split("@")[1]) < i), default=-1)
        if m <= cut:
            want.append((i, "dropped"))
        elif max((x // 60 for x in times[: i - 1]), default=-1) > m // 60:
            want.append((i, "corrected"))
    assert rows(late_events.late_rows(log, marks(spark, *saved))) == sorted(want, key=repr)


def test_late_rows_nulls_and_empty(spark, make_log):
    log = make_log({"timestamp": None}, {"organization": None}, {"id": None}, {"id": " "})
    assert rows(late_events.late_rows(log, marks(spark))) == []
    assert rows(late_events.late_rows(spark.createDataFrame([], LOG), marks(spark))) == []
    assert rows(late_events.period_counts(spark.createDataFrame([], LOG), marks(spark))) == []


def test_multiset_is_corrected_by_late_batches(spark):
    r = random.Random(1)
    values = [("a", r.randrange(2000)) for _ in range(301)] + [("b", 7), ("b", 9)]
    df = spark.createDataFrame(values, "k string, v int")
    early, late = spark.createDataFrame(values[:100], "k string, v int"), spark.createDataFrame(values[100:], "k string, v int")
    state = late_events.adjust(late_events.multiset(early, ["k"], F.col("v")), late_events.multiset(late, ["k"], F.col("v")), ["k"])
    assert rows(state) == rows(late_events.multiset(df, ["k"], F.col("v")))
    a = sorted(v for k, v in values if k == "a")
    assert {tuple(x) for x in late_events.derive(state, ["k"]).collect()} == {("a", 301, len(set(a)), a[0], a[-1], float(a[150])), ("b", 2, 2, 7, 9, 8.0)}


def test_multiset_withdrawal(spark):
    state = spark.createDataFrame([("a", 1, 2), ("a", 5, 1)], "k string, value int, n bigint")
    gone = spark.createDataFrame([("a", 5, -1), ("a", 1, -1)], "k string, value int, n bigint")
    assert rows(late_events.adjust(state, gone, ["k"])) == [("a", 1, 1)]


def test_period_counts(spark, make_log):
    log = make_log(*({"timestamp": START + timedelta(minutes=m), "payload": "x" * s, "event_key": k} for m, s, k in ((5, 1, "a"), (70, 3, "a"), (10, 4, "b"), (11, 8, "a"))))
    got = {r["period"]: r for r in late_events.period_counts(log, marks(spark, ("acme@3", 11, 1))).collect()}
    first = got[START]
    assert (first["n_on_time"], first["n_corrected"], first["n_dropped"], first["n_events"], first["n_keys"]) == (1, 1, 1, 2, 2)
    assert (first["min_size"], first["max_size"], first["median_size"]) == (1, 4, 2.5)


@pytest.mark.parametrize("batches", [2, 7])
def test_counts_do_not_depend_on_the_batches(spark, make_log, monkeypatch, batches):
    monkeypatch.setattr(late_events, "BLOCK", 4)
    r = random.Random(5)
    log = make_log(*({"timestamp": START + timedelta(minutes=r.randrange(400)), "payload": "x" * r.randrange(9), "event_key": r.choice("abc"), "organization": r.choice(["acme", "other"])} for _ in range(70)))
    saved = marks(spark, *((f"acme@{s}", r.randrange(200), 1) for s in range(0, 90, 7)))
    assert rows(late_events.period_counts(log, saved, batches)) == rows(late_events.period_counts(log, saved))
    assert {r["n_dropped"] > 0 for r in late_events.period_counts(log, saved).collect()} == {True, False}


# ---- heavy keys ----


def test_key_totals_match_a_group_by(spark, make_log):
    r = random.Random(2)
    log = make_log(*({"event_key": r.choice(["hot"] * 5 + [f"k{i}" for i in range(40)] + [""]), "partition_id": r.choice([None, 1, 2])} for _ in range(500))).repartition(7)
    got = rows(heavy_keys.key_totals(log, ["event_key", "partition_id"], sequence="sequence", timestamp="timestamp"))
    want = []
    for f in ("event_key", "partition_id"):
        by = log.groupBy(F.col(f).cast("string").alias("v")).agg(F.count("*"), F.max("sequence"), F.min("timestamp"), F.max("timestamp")).collect()
        want += [(f, r[0], r[0] is None, *r[1:]) for r in by]
    assert got == sorted(want, key=repr)


def test_key_totals_two_rounds(spark, make_log, monkeypatch):
    monkeypatch.setattr(heavy_keys, "FAN", 2)
    log = make_log(*({"event_key": f"k{i % 5}"} for i in range(100))).repartition(9)
    assert rows(heavy_keys.key_totals(log, ["event_key"]).select("val", "n")) == [(f"k{i}", 20) for i in range(5)]


def test_heavy_values_share(spark, make_log):
    log = make_log(*({"event_key": "hot" if i < 3 else f"k{i}", "partition_key": None, "partition_id": 5 if i < 2 else None} for i in range(100)))
    assert rows(heavy_keys.heavy_values(log, heavy_keys.LOG_FIELDS)) == [("event_key", "hot")]
    assert rows(heavy_keys.heavy_values(spark.createDataFrame([], LOG), heavy_keys.LOG_FIELDS)) == []


# ---- orphans ----


def test_orphan_kinds(spark, make_log):
    log = make_log(
        {"parent_id": uid(3)}, {"parent_id": "{" + uid(1).upper() + "}", "causation_id": "cmd-1"}, {"parent_id": uid(90), "causation_id": "urn:uuid:" + uid(91)}, {"parent_id": "  ", "causation_id": uid(4)},
        {"sequence": 5, "id": uid(1), "parent_id": uid(99)},
    )
    done = spark.createDataFrame([(uid(90).replace("-", ""), "s", START), (uid(90), "s", START), (uid(77) + "\t", "s", None), (uid(1), "s", START), (None, "s", START), (uid(78), None, START)], "event_id string, subscriber_id string, completed_at timestamp_ntz")
    kept = spark.createDataFrame([(uid(90), START), (None, START)], "event_id string, processed_at timestamp_ntz")
    got = rows(orphans.orphan_references(log, done, kept).drop("day"))
    assert got == sorted([
        (orphans.PARENT, uid(3), "1", "late"), (orphans.PARENT, uid(90), "3", "deleted"), (orphans.CAUSE, uid(91), "3", "missing"),
        (orphans.DONE, uid(90), "s", "deleted"), (orphans.DONE, uid(77), "s", "missing"),
    ])
    counts = rows(orphans.orphan_counts(log, done, kept).groupBy("src").agg(F.sum("n_refs")))
    assert counts == [(orphans.CAUSE, 1), (orphans.PARENT, 2), (orphans.DONE, 2)]


def test_orphans_hot_key_and_empty(spark, make_log, monkeypatch):
    monkeypatch.setattr(lookup, "HOT", 20)
    log = make_log(*({"parent_id": uid(9999) if i % 3 else uid(8000 + i)} for i in range(200)))
    empty = spark.createDataFrame([], "event_id string, subscriber_id string, completed_at timestamp_ntz")
    kept = spark.createDataFrame([], "event_id string, processed_at timestamp_ntz")
    assert orphans.orphan_references(log, empty, kept).count() == 200
    assert orphans.orphan_references(spark.createDataFrame([], LOG), empty, kept).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_safe_lookup_equals_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(lookup, "HOT", 10)
    r = random.Random(5)
    left = spark.createDataFrame([(i, r.choice([1, 1, 1, 2, 3, 4, None, 9])) for i in range(200)], "i int, k int")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (7, "x")], "k int, v string")
    assert rows(lookup.skew_safe_lookup(left, table, "k", how).select("i", "k", "v")) == rows(left.join(table, "k", how).select("i", "k", "v"))


# ---- incremental ----


def order(n):
    return bytearray((n + (1 << 63)).to_bytes(8, "big"))


OFFSETS = "consumer_group_id string, stream_id string, cursor_id string, cursor string, cursor_order binary"


def test_pending_by_cursor(spark, make_log, monkeypatch):
    monkeypatch.setattr(incremental, "SPAN", 4)
    monkeypatch.setattr(incremental, "FANOUT", 2)
    log = make_log(*({"partition_id": None if i % 5 == 0 else i % 3} for i in range(1, 41)), {"sequence": 50, "id": uid(3), "partition_id": 0})
    offsets = spark.createDataFrame([
        ("g", "s", "global", '{"sequence":9}', order(17)), ("g", "s", "global", '{"sequence":30}', order(12)), ("g", "s", "partition:32:1", "{}", order(99)),
        ("h", "s", "partition:64:0", '{"sequence":"21"}', None), ("h", "s", "partition:64:1", '{"sequence":30', bytearray(b"x")), ("h", "s", "left:global", None, order(40)),
        ("i", "s", "replay:global", None, order(1)),
    ], OFFSETS)
    got = {tuple(r) for r in incremental.pending(log, offsets).collect()}
    want = {("g", "s", i) for i in range(18, 41)} | {("h", "s", i) for i in range(1, 41) if i % 5 and (i > 21 if i % 3 == 0 else True)}
    assert got == want
    assert incremental.pending(log, spark.createDataFrame([], OFFSETS)).count() == 0
    assert incremental.pending(spark.createDataFrame([], LOG), offsets).count() == 0


def test_trees_are_opened_only_where_they_differ(spark, make_log, monkeypatch):
    monkeypatch.setattr(incremental, "SPAN", 4)
    monkeypatch.setattr(incremental, "FANOUT", 2)
    scratch = incremental.Scratch(spark, "test")
    log = make_log(*({"partition_id": i % 2, "payload": f'{{"n":{i}}}'} for i in range(1, 41)))
    changed = log.withColumn("payload", F.when(F.col("sequence") == 6, "{}").otherwise(F.col("payload"))).unionByName(make_log({"sequence": 50, "partition_id": 1}))
    offsets = spark.createDataFrame([("g", "s", "global", None, order(22)), ("h", "s", "partition:64:0", None, order(40)), ("k", "s", "global", None, order(2**63 - 1))], OFFSETS)
    marks = incremental.event_marks(log, scratch)
    saved = incremental.saved_of(marks, incremental.event_tree(marks, scratch), offsets, scratch)
    at = scratch.path("saved")
    saved.write(at)
    saved = incremental.Saved.read(spark, at, len(saved.tree) - 1)
    now = incremental.event_marks(changed, scratch)
    tree = incremental.event_tree(now, scratch)
    # a payload that changed behind the cursors, at 6, is found in its leaf, 1; of the other leaves only the cursor's own and later ones are opened
    opened = sorted((r["consumer_group_id"], r["node"]) for r in incremental.differing_for(tree, saved, scratch).where("tree in ('all', '1')").collect())
    assert opened == sorted([("g", n) for n in (1, 5, 6, 7, 8, 9, 10, 12)] + [("h", n) for n in (*range(10), 12)] + [("k", 1), ("k", 12)])
    got = {(r["consumer_group_id"], r["sequence"], r["change"]) for r in incremental.changes_for(now, tree, saved, scratch).collect()}
    later = {("g", i, "added") for i in (*range(23, 41), 50)} | {("h", i, "added") for i in (*range(1, 41, 2), 50)} | {("k", 50, "added")}
    assert got == later | {(g, 6, "changed") for g in "ghk"}


def test_differences_of_every_kind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "SPAN", 4)
    monkeypatch.setattr(incremental, "FANOUT", 2)
    job = incremental.Incremental(spark, f"file://{tmp_path}/job")
    make = lambda pairs: spark.createDataFrame(pairs, "n int, digest string, m map<string,string>")
    first = make([(i, "v", {"a": "b", "c": "d"}) for i in range(30)] + [(None, "v", {})])
    job.run(first, "n", lambda d: d)
    second = make([(i, "w" if i == 9 else "v", {"c": "d", "a": "e" if i == 17 else "b"}) for i in range(33) if i != 4])
    assert rows(job.differences(second, "n").select("key", "change")) == sorted([(9, "changed"), (17, "changed"), (4, "deleted"), (30, "added"), (31, "added"), (32, "added")], key=repr)
    fresh, _ = job.changes(second, "n")
    assert sorted(r["n"] for r in fresh.collect()) == [9, 17, 30, 31, 32] and fresh.columns == ["n", "digest", "m"]
    assert job.changes(make([]), "n")[0].count() == 0


def test_of_two_runs_at_once_one_is_published(spark, tmp_path):
    base = f"file://{tmp_path}/job"
    job, other = incremental.Incremental(spark, base), incremental.Incremental(spark, base)
    source = spark.range(10).withColumnRenamed("id", "n")

    def meanwhile(rows):
        other.run(source, "n", lambda d: d)
        return rows

    with pytest.raises(incremental.Conflict):
        job.run(source, "n", meanwhile)
    assert job.output().count() == 10
    job.run(spark.range(12).withColumnRenamed("id", "n"), "n", lambda d: d)
    job.compact()
    assert job.output().count() == 12 and len(job.current()["runs"]) == 1
    assert rows(job.changes(spark.range(12).withColumnRenamed("id", "n"), "n")[0]) == []


def test_run_publishes_output_and_tree_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "SPAN", 8)
    job = incremental.Incremental(spark, f"file://{tmp_path}/job")
    first = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "n bigint, v string")
    job.run(first, "n", lambda d: d)
    second = spark.createDataFrame([(i, "changed" if i == 7 else f"v{i}") for i in range(45)], "n bigint, v string")
    with pytest.raises(Exception):  # noqa: B017
        job.run(second, "n", lambda d: d.select(F.raise_error(F.lit("no")).alias("n")))
    assert job.output().count() == 40
    job.run(second, "n", lambda d: d)
    assert rows(job.changes(second, "n")[0]) == []
    assert sorted(r["n"] for r in job.output().collect()) == sorted([*range(40), 7, *range(40, 45)])


def test_equal_rows_do_not_cancel_out(spark):
    one = spark.createDataFrame([("all", 0, 5)], "tree string, node bigint, digest bigint")
    three = one.unionByName(one).unionByName(one)
    trees = [incremental.levels(incremental.leaves(x, ["tree"]), ["tree"], 2) for x in (one, three)]
    assert rows(incremental.differing(*trees, ["tree"])) == [("all", 0)]
    assert rows(incremental.differing(trees[0], trees[0], ["tree"])) == []


# ---- schema drift ----


def versions(make_log, *objects, topic="t"):
    made = []
    for v, payload, kind in objects:
        made.append({"topic": topic, "version": v, "payload": payload, "content_type": kind})
    return make_log(*made)


def test_changes_of_every_kind(make_log):
    r = random.Random(4)
    code = lambda: f"SK-{r.randrange(10**4):04d}"
    old = [json.dumps({"sku": code(), "when": f"2031-0{r.randrange(1, 9)}-11", "n": r.randrange(100), "tags": ["a"], "site": {"zone": r.choice("xyz")}, "ok": True, "gone": 1.5 + i}) for i in range(80)]
    new = [json.dumps({"article": code(), "when": 19000 + i, "n": None if i % 2 else 5, "labels": ["a"], "site": {"zone": r.choice("xyz"), "ok": False}, "extra": {"a": 1}}) for i in range(80)]
    broken = [(2, "{", "application/json"), (2, "bm90IGpzb24=", "application/octet-stream"), (2, None, "application/json"), (2, "[1]", "application/json")]
    coded = [(2, base64.b64encode(x.encode()).decode(), "application/octet-stream") for x in new]
    log = versions(make_log, *((1, x, "application/json") for x in old), *coded, *broken)
    got = {tuple(r)[2:] for r in schema_drift.schema_changes(log).collect()}
    assert got == {
        ("recoded", "content_type", ""), ("renamed", "sku", "article"), ("retyped", "when", ""), ("renamed", "tags", "labels"),
        ("renamed", "ok", "site.ok"), ("removed", "gone", ""), ("added", "extra", ""),
    }


def test_fusing_does_not_depend_on_the_split(make_log):
    r = random.Random(9)
    found = [{"a": r.choice([1, 2.5, "x", None, True, {"b": 1}, [1, "y"]]), "s": f"v{r.randrange(200)}"} for _ in range(300)]
    whole = {}
    for x in found:
        schema_drift.observe(whole, x, "j")
    parts = []
    for i in range(0, 300, 37):
        part = {}
        for x in found[i : i + 37]:
            schema_drift.observe(part, x, "j")
        parts.append(json.loads(json.dumps(part)))
    r.shuffle(parts)
    fused = {}
    for part in parts:
        fused = schema_drift.fuse(fused, part)
    assert fused == whole


def union_of(values):
    union = {}
    for value in values:
        schema_drift.observe(union, value, "j")
    return json.loads(json.dumps(union))


@pytest.mark.parametrize("n", [56, 600, 3000])
def test_renames_do_not_depend_on_the_number_of_rows(n):
    r = random.Random(n)
    marks = ["".join(c) for c in itertools.product(" ,.;", repeat=6)]
    text = lambda at: "x".join(["a", *marks[at], "b"])
    free = lambda: "x".join(["a", *r.choices(" ,.;", k=14), "b"])
    kinds = {
        "moving days": (lambda i: f"2031-01-{i % 28 + 1:02d}", lambda i: f"2031-02-{i % 28 + 1:02d}"),
        "one passes the set's size": (lambda i: f"B-{i % 60:03d}", lambda i: f"B-{i % 70:03d}"),
        "one passes the forms' size": (lambda i: text(i % 250), lambda i: text(i % 270)),
        "free text, all new": (lambda i: free(), lambda i: free()),
    }
    for name, (was, now) in kinds.items():
        old, new = union_of({"was": was(i)} for i in range(n)), union_of({"now": now(i)} for i in range(n))
        assert (name, schema_drift.changes(old, new)) == (name, [("renamed", "was", "now")])
    old, new = union_of({"was": f"{r.randrange(16**12):012x}"} for _ in range(n)), union_of({"now": free()} for _ in range(n))
    assert schema_drift.changes(old, new) == [("added", "now", ""), ("removed", "was", "")]


def renames(was, now, n=400):
    old, new = union_of({"was": was(i)} for i in range(n)), union_of({"now": now(i)} for i in range(n))
    return [c for c, _, _ in schema_drift.changes(old, new)] == ["renamed"]


def test_evidence_of_renames():
    r = random.Random(8)
    law = lambda i: " ".join(r.choices(["party", "shall", "hereby", "liable", "clause", "Agreement"], k=60))
    stack = lambda i: " ".join(f"at {r.choice(['java', 'org', 'io'])}.{r.choice(['Main', 'Run'])}({r.randrange(99)})" for _ in range(30))
    assert renames(law, law) and renames(stack, stack) and not renames(law, stack)
    assert renames(lambda i: i % 50 + 0.5, lambda i: 1e9 if i == 7 else i % 50 + 0.25)
    assert not renames(lambda i: i % 50 + 0.5, lambda i: 1000.5 + i % 50)
    assert renames(lambda i: i % 9 == 0, lambda i: i % 8 == 0) and not renames(lambda i: i % 9 == 0, lambda i: i % 9 != 0)


def test_ids_as_names_make_no_fields(make_log, monkeypatch):
    monkeypatch.setattr(schema_drift, "HELD", 50)
    r = random.Random(8)
    old = [(1, json.dumps({"by": {f"u{r.randrange(10**9)}": 1, "all": i}, "a": "x"}), "j") for i in range(200)]
    new = [(2, json.dumps({"by": {f"u{r.randrange(10**9)}": 1}, "a": 5}), "j") for i in range(200)]
    log = versions(make_log, *old, *new).repartition(5)
    assert {tuple(r)[2:] for r in schema_drift.schema_changes(log).collect()} == {("retyped", "a", ""), ("removed", "by.all", "")}
    assert schema_drift.unions(schema_drift.payload_rows(log)).count() == 7


def test_plans_too_long_to_send_are_joined(make_log, monkeypatch):
    log = versions(make_log, *[(v, json.dumps({n: i}), "j") for v, n in ((1, "qty"), (2, "amount")) for i in range(20)])
    sent = rows(schema_drift.consistent_table(log))
    monkeypatch.setattr(schema_drift, "PLANS", 0)
    assert rows(schema_drift.consistent_table(log)) == sent and len(sent) == 40


def test_consistent_table(make_log):
    log = versions(make_log, (1, '{"qty":3,"u":{"z":"a"}}', "application/json"), (2, '{"qty":"4"}', "application/json"), (2, '{"qty":"x"}', "application/json"), (2, "nothing", "application/json"))
    got = {r["sequence"]: r["fields"] for r in schema_drift.consistent_table(log).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["qty"]["tag"], got[1]["qty"]["number"], got[1]["qty"]["canonical"]) == ("number", 3.0, "3")
    assert (got[2]["qty"]["tag"], got[2]["qty"]["text"], got[2]["qty"]["canonical"]) == ("string", "4", "4")
    assert got[1]["u.z"]["text"] == "a"


def test_stragglers_get_the_latest_name(make_log):
    old = [(1, json.dumps({"qty": i}), "j") for i in range(20)]
    new = [(v, json.dumps({"amount": i}), "j") for v in (2, 3) for i in range(20)]
    late = [(2, '{"qty":5}', "j"), (3, '{"qty":6}', "j"), (3, '{"qty":7,"amount":8}', "j"), (3, '{"qty":9,"amount":null}', "j")]
    got = {r["sequence"]: {k: x["number"] for k, x in r["fields"].items()} for r in schema_drift.consistent_table(versions(make_log, *old, *new, *late)).collect()}
    assert [got[n] for n in (1, 21, 61, 62, 63, 64)] == [{"amount": 0}, {"amount": 0}, {"amount": 5}, {"amount": 6}, {"amount": 8, "qty": 7}, {"amount": 9}]


def test_drift_of_nothing(spark, make_log):
    assert schema_drift.schema_changes(spark.createDataFrame([], LOG)).count() == 0
    assert schema_drift.schema_changes(make_log({"topic": None}, {"version": None}, {"payload": None})).count() == 0
    assert schema_drift.consistent_table(spark.createDataFrame([], LOG)).count() == 0


# ---- hierarchy ----


def test_places_paths_and_cycles(spark, make_log, monkeypatch):
    monkeypatch.setattr(hierarchy, "SMALL", 2)
    log = make_log(
        {}, {"parent_id": uid(1)}, {"parent_id": " ", "causation_id": uid(2).upper()}, {"parent_id": uid(4)}, {"parent_id": uid(6)}, {"parent_id": uid(5)}, {"parent_id": uid(6)}, {"parent_id": uid(500)},
        {"causation_id": "cron/x"}, {"parent_id": "no uuid", "causation_id": uid(1)}, {"sequence": 11, "id": uid(2), "parent_id": uid(9)},
    )
    assert rows(hierarchy.tree_places(log)) == [(2, 1, 1), (3, 1, 2), (4, 4, -1), (5, 5, -1), (6, 5, -1), (7, 5, -1)]
    got = {r["sequence"]: r for r in hierarchy.tree_paths(log).collect()}
    assert (got[3]["path"], got[1]["n_descendants"], got[2]["n_descendants"], got[10]["path"]) == ("1/2/3", 2, 1, "10")
    assert rows(hierarchy.descendants(log)) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    assert rows(hierarchy.cycles(log)) == [(4, 4, True), (5, 5, True), (6, 5, True), (7, 5, False)]


@pytest.mark.parametrize(("hot", "small", "deep"), [(100_000, 10_000, 16), (3, 10_000, 16), (3, 0, 16), (100_000, 20, 16), (100_000, 0, 1), (3, 0, 0)])
def test_random_forests(spark, make_log, monkeypatch, hot, small, deep):
    monkeypatch.setattr(hierarchy, "DEEP", deep)
    monkeypatch.setattr(lookup, "HOT", hot)
    monkeypatch.setattr(hierarchy, "HOT", hot)
    monkeypatch.setattr(hierarchy, "SMALL", small)
    r = random.Random(7)
    up = {i: r.choice([None, 1, r.randrange(1, 61)]) for i in range(1, 61)}
    log = make_log(*({"parent_id": uid(up[i]) if up[i] else None} for i in range(1, 61)))
    want = []
    for i in up:
        seen, x = [], i
        while up[x] and x not in seen:
            seen.append(x)
            x = up[x]
        if x in seen:
            want.append((i, min(seen[seen.index(x) :]), -1))
        elif seen:
            want.append((i, x, len(seen)))
    assert rows(hierarchy.tree_places(log)) == sorted(want, key=repr)
    paths = {r["sequence"]: r["path"] for r in hierarchy.tree_paths(log).collect()}
    for i in up:
        trail, x = [i], i
        while up[x] and len(trail) < 99:
            x = up[x]
            trail.append(x)
        assert paths[i] == (None if len(trail) == 99 else "/".join(map(str, reversed(trail))))


def test_a_long_chain_and_a_hot_cycle(spark, monkeypatch):
    """A chain of 50,000 links and 200,000 nodes below one that is its own parent; the pointers of those all lead to it."""
    monkeypatch.setattr(lookup, "HOT", 20_000)
    monkeypatch.setattr(hierarchy, "DEEP", 2)
    chain, loop = 50_000, 1_000_000
    links = spark.range(chain + 1).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    links = links.unionByName(spark.range(loop, loop + 200_001).select(F.col("id").alias("node"), F.lit(loop).cast("bigint").alias("parent")))
    tree = hierarchy.build(links, hierarchy.Scratch(spark, "test"))
    got = tree.reached.agg(F.count("*"), F.max("depth"), F.sum((F.col("depth") == F.col("node")).cast("int")), F.max("root")).head()
    assert tuple(got) == (chain + 1, chain, chain + 1, 0)
    lost = tree.cyclic().agg(F.count("*"), F.min("low"), F.max("low"), F.sum(F.col("on_cycle").cast("int"))).head()
    assert tuple(lost) == (200_001, loop, loop, 1)
    assert tree.reached._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 5


def test_hierarchy_of_nothing(spark):
    assert hierarchy.tree_places(spark.createDataFrame([], LOG)).count() == 0
    assert hierarchy.tree_paths(spark.createDataFrame([], LOG)).count() == 0


# ---- all of them ----


def test_extra_columns_with_clashing_names_change_nothing(spark, make_log, tmp_path):
    log = make_log({}, {"parent_id": uid(1), "timestamp": START - timedelta(hours=2)}, {"parent_id": uid(50)}, {"partition_id": 3})
    names = ["event", "node", "parent", "root", "depth", "block", "period", "outcome", "ref", "born", "tree", "digest", "row", "day", "up", "lane", "union", "n", "size", "value", "count", "field", "val", "ts", "_hot", "pos"]
    more = log.withColumns({c: F.lit("clash") for c in names})
    saved = marks(spark).withColumn("organization", F.lit("x")).withColumn("sequence", F.lit("x"))
    done = spark.createDataFrame([(uid(60), "s", START, 1, 2)], "event_id string, subscriber_id string, completed_at timestamp_ntz, ref int, day int")
    kept = spark.createDataFrame([(uid(60), START, 1)], "event_id string, processed_at timestamp_ntz, ref int")
    offsets = spark.createDataFrame([("g", "s", "global", "{}", order(1), 1, 2)], OFFSETS + ", pos int, tree int")
    for run in (
        lambda x: late_events.late_rows(x, saved), lambda x: late_events.period_counts(x, saved), lambda x: heavy_keys.key_totals(x, heavy_keys.LOG_FIELDS, sequence="sequence", timestamp="timestamp"),
        lambda x: orphans.orphan_references(x, done, kept), lambda x: incremental.pending(x, offsets), schema_drift.schema_changes, hierarchy.tree_places, hierarchy.tree_paths,
    ):
        assert rows(run(more)) == rows(run(log))
    assert [r["sequence"] for r in incremental.Incremental(spark, f"file://{tmp_path}/j").changes(more, "sequence")[0].orderBy("sequence").collect()] == [1, 2, 3, 4]
