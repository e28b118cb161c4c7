"""Every query with SQL gives the rows of its SQL on the stored tables; every other one runs."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from seqloom.operators import heavy_keys, hierarchy, incremental, late_events, lookup, ordering
from seqloom.plans import log_queries, problems, stream_queries

REGISTRIES = [problems.registry, log_queries.registry, stream_queries.registry]
QUERIES = {k: q for r in REGISTRIES for k, q in r.queries.items()}
SQL = {k: s for r in REGISTRIES for k, s in r.sql.items()}


@pytest.fixture(scope="module")
def base(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return round(float(value), 6) if isinstance(value, int | float) and not isinstance(value, bool) else value


def found(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, base, name):
    df = QUERIES[name](spark, data)
    want = base.sql(SQL[name])
    assert found(df.columns, [tuple(r) for r in df.collect()]) == found(want.columns, want.fetchall())


CROSSING = [
    "p1_found", "p1_batches", "p2_found", "p2_key_totals", "p3_found", "p4_found", "p4_changes", "p6_found", "p6_paths", "p6_cycles", "lane_order", "lane_round_robin", "watermark_per_key", "watermark_monotone",
    "batch_by_count", "merge_weighted", "rate_schedule", "checkpoint_resume", "checkpoint_flush_points", "pending_limit", "lane_jam", "append_log",
]


@pytest.mark.parametrize("name", CROSSING)
def test_query_equals_its_sql_across_borders(spark, data, base, name, monkeypatch):
    """The same with blocks, spans and limits so small that these tables have many of each and every branch is taken."""
    for module, limits in (
        (ordering, {"BLOCK": 100}), (late_events, {"BLOCK": 100, "COARSE": 8}), (incremental, {"SPAN": 64, "FANOUT": 4, "RANGES": 3}), (lookup, {"HOT": 40}), (hierarchy, {"HOT": 40, "SMALL": 5, "DEEP": 2}),
        (heavy_keys, {"BLOCK_ROWS": 64, "FAN": 2}),
    ):
        for limit, value in limits.items():
            monkeypatch.setattr(module, limit, value)
    df = QUERIES[name](spark, data)
    want = base.sql(SQL[name])
    assert found(df.columns, [tuple(r) for r in df.collect()]) == found(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark, data):
    assert entry.entry(spark).columns == ["sequence", "outcome"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


COLUMNS = {
    "p1_found": "sequence bigint, outcome string", "p2_found": "field string, val string", "p3_found": "src string, ref_id string, row_key string, kind string",
    "p4_found": "consumer_group_id string, stream_id string, sequence bigint", "p5_found": "topic string, version bigint, change string, field string, new_field string",
    "p6_found": "sequence bigint, root_sequence bigint, depth int",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_columns(spark, data, name):
    df = QUERIES[name](spark, data)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    assert df.count() == df.distinct().count()
