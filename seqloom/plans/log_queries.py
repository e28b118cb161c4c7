"""Queries of scans, positions, filters, partitions and scalar functions over the stored event log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import envelope as E
from seqloom.functions.fnv import fnv1a64, unsigned_mod
from seqloom.operators import filters, handlers, partitioning, sinks
from seqloom.operators.filters import EventFilter
from seqloom.operators.positions import Partitions, StartFrom, StopAt, Subscription, scan
from seqloom.operators.stateful import merge_cursor
from seqloom.operators.stores import monotone_checkpoints, resume_after
from seqloom.plans.registry import Registry
from seqloom.sources.tables import table

registry = Registry()
add = registry.add

SHOWN = ["sequence", "id", "organization", "namespace", "topic", "event_key", "timestamp", "version"]
COLS = ", ".join(SHOWN)
FROM = f"select {COLS} from event_log"
SPREAD = 1000
"""Sequences in one unit of the fixed positions below."""


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_log")


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*SHOWN, *more)


def scans(name: str, sub: Subscription, where: str) -> None:
    """Register a subscription and the same predicates in SQL."""
    add(name, f"{FROM} {where}")(lambda spark, d: shown(scan(log(spark, d), sub)))


# ---- scans and positions ----

scans("scan_log", Subscription(StartFrom("earliest"), StopAt("current_end"), EventFilter(namespace="/shop")), "where (namespace = '/shop' or starts_with(namespace, '/shop/'))")
scans("start_earliest", Subscription(StartFrom("earliest")), "where sequence > 0")
scans("start_timestamp", Subscription(StartFrom("timestamp", "2031-03-15 00:00:00")), "where \"timestamp\" >= timestamp '2031-03-15 00:00:00'")
scans("start_after", Subscription(StartFrom.after(5 * SPREAD)), "where sequence > 5000")
scans("stop_current_end", Subscription(StartFrom("earliest"), StopAt("current_end"), EventFilter(organization="ninefold")), "where organization = 'ninefold' and sequence <= (select max(sequence) from event_log where organization = 'ninefold')")
scans("stop_at_cursor", Subscription(StartFrom("earliest"), StopAt("cursor", 3 * SPREAD)), "where sequence <= 3000")
scans("scan_limit", Subscription(StartFrom.after(SPREAD), limit=100), "where sequence > 1000 order by sequence limit 100")
scans("memory_limit", Subscription(StartFrom("earliest"), limit=25), "where sequence > 0 order by sequence limit 25")


@add("start_latest", f"{FROM} where organization = 'brightmoor' and sequence > (select max(sequence) from event_log where organization = 'brightmoor' and sequence <= 6000)")
def start_latest(spark: SparkSession, d: str) -> DataFrame:
    """Rows that came after the end as seen at sequence 6000."""
    return shown(scan(log(spark, d), Subscription(StartFrom("latest"), filter=EventFilter(organization="brightmoor")), as_of=6 * SPREAD))


CHECKPOINTS = """checkpoints as (
  select consumer_group_id, stream_id, cursor_id, max(hex(cursor_order)) as o
  from offsets where octet_length(cursor_order) = 8 group by all),
positions as (
  select consumer_group_id, stream_id, cursor_id, (('0x' || o)::uhugeint::hugeint - 9223372036854775808)::bigint as position from checkpoints)"""


@add("checkpoint_monotone", f"with {CHECKPOINTS} select * from positions")
def checkpoint_monotone(spark: SparkSession, d: str) -> DataFrame:
    return monotone_checkpoints(table(spark, d, "offsets")).drop("cursor")


@add("resume_min_cursor", f"with {CHECKPOINTS} select consumer_group_id, stream_id, min(position) as start from positions group by all")
def resume_min_cursor(spark: SparkSession, d: str) -> DataFrame:
    return resume_after(monotone_checkpoints(table(spark, d, "offsets")))


@add("resume_partition_compat", f"with {CHECKPOINTS} select consumer_group_id, stream_id, min(position) as start from positions where regexp_full_match(cursor_id, 'partition:64:[0-9]+') group by all")
def resume_partition_compat(spark: SparkSession, d: str) -> DataFrame:
    """Only cursors of the partition count in use can seed a partitioned reader."""
    return resume_after(monotone_checkpoints(table(spark, d, "offsets")), F.col("cursor_id").rlike("^partition:64:[0-9]+$"))


# ---- filters and projections ----

SHOP = "(namespace = '/shop' or starts_with(namespace, '/shop/'))"
FULL = EventFilter("brightmoor", "order.submitted", "/shop", ["none", "device-gateway-0032", "acct-949642"], {"region": "eu-north"}, "2031-03-20 00:00:00")


def picks(name: str, condition: filters.Filter, where: str) -> None:
    add(name, f"{FROM} where {where}")(lambda spark, d: shown(log(spark, d).where(filters.column(condition))))


picks("event_filter_full", FULL, f"organization = 'brightmoor' and topic = 'order.submitted' and {SHOP} and event_key in ('none', 'device-gateway-0032', 'acct-949642') and metadata['region'] = 'eu-north' and \"timestamp\" <= timestamp '2031-03-20 00:00:00'")
picks("filter_topic", EventFilter(topic="cart.updated"), "topic = 'cart.updated'")
picks("filter_namespace", EventFilter(namespace="/shop/cart"), "(namespace = '/shop/cart' or starts_with(namespace, '/shop/cart/'))")
picks("filter_keys", EventFilter(keys=["none", "00000000"]), "event_key in ('none', '00000000')")
picks("filter_metadata", EventFilter(metadata={"producer": "edge-relay", "region": "eu-west"}), "metadata['producer'] = 'edge-relay' and metadata['region'] = 'eu-west'")
picks("filter_combinators", filters.all_of(filters.any_of(EventFilter(topic="cart.updated"), EventFilter(organization="ninefold")), filters.negate(EventFilter(namespace="/shop"))), f"(topic = 'cart.updated' or organization = 'ninefold') and not {SHOP}")
picks("filter_any_of", filters.any_of(EventFilter(topic="job.finished"), EventFilter(keys=[]), EventFilter(metadata={"region": "eu-north"})), "topic = 'job.finished' or coalesce(metadata['region'] = 'eu-north', false)")


@add("filter_advances_cursor", "select organization, max(sequence) as cursor, count(*) filter (topic = 'cart.updated') as delivered, count(*) as seen from event_log group by organization")
def filter_advances_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a filter drops are acked, so the cursor goes to the last row seen."""
    hit = EventFilter(topic="cart.updated").column()
    return log(spark, d).groupBy("organization").agg(F.max("sequence").alias("cursor"), F.count_if(hit).alias("delivered"), F.count("*").alias("seen"))


@add("map_events", "select sequence, upper(topic) as topic, octet_length(encode(payload)) as payload from event_log")
def map_events(spark: SparkSession, d: str) -> DataFrame:
    return sinks.mapped(log(spark, d), {"topic": F.upper("topic"), "payload": F.octet_length("payload").cast("bigint")}).select("sequence", "topic", "payload")


@add("try_map_split", "select sequence, try_cast(event_key as bigint) as number, case when try_cast(event_key as bigint) is null then 'not a number' end as error from event_log")
def try_map_split(spark: SparkSession, d: str) -> DataFrame:
    """A mapping that can fail keeps the row, with its error."""
    number = F.when(F.col("event_key").rlike("^[+-]?[0-9]{1,18}$"), F.col("event_key").try_cast("bigint"))
    return log(spark, d).select("sequence", number.alias("number"), F.when(number.isNull(), "not a number").alias("error"))


READABLE = "(json_valid(payload) and coalesce(json_type(case when json_valid(payload) then payload end) = 'OBJECT', false))"


@add("decode_payload", f"select sequence, topic, json_extract_string(payload, '$.currency') as currency from event_log where content_type <> 'application/octet-stream' and {READABLE}")
def decode_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d).where(F.col("content_type") != "application/octet-stream")
    return rows.where(E.is_object(F.col("payload"))).select("sequence", "topic", F.try_variant_get(F.try_parse_json("payload"), "$.currency", "string").alias("currency"))


@add("decode_errors", f"select sequence, topic, 'payload is no object' as error from event_log where content_type <> 'application/octet-stream' and not {READABLE}")
def decode_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d).where(F.col("content_type") != "application/octet-stream")
    return rows.where(~E.is_object(F.col("payload"))).select("sequence", "topic", F.lit("payload is no object").alias("error"))


TEXT = "(case when content_type = 'application/octet-stream' then try(decode(from_base64(regexp_replace(payload, '\\s', '', 'g')))) else payload end)"
OBJECT = f"coalesce(try(json_type({TEXT}::json)) = 'OBJECT', false)"


@add("decode_dispositions", f"select disposition, topic, count(*) as n, count(*) filter (ok) as n_readable, count(*) filter (not ok and disposition = 'ack') as n_acked, count(*) filter (not ok and disposition = 'nack') as n_nacked from (select topic, {OBJECT} as ok from event_log), (select unnest(['surface', 'ack', 'nack']) as disposition) group by all")
def decode_dispositions(spark: SparkSession, d: str) -> DataFrame:
    """What a decoding reader does with what it can't decode, binary payloads included, under each of its policies."""
    good = E.is_object(E.payload_text(F.col("payload"), F.col("content_type")))
    rows = log(spark, d).select("topic", good.alias("good"))
    each = [handlers.decoded(rows, F.col("good"), kind).select(F.lit(kind).alias("disposition"), "topic", "readable", "settlement") for kind in ("surface", "ack", "nack")]
    return reduce(DataFrame.unionByName, each).groupBy("disposition", "topic").agg(
        F.count("*").alias("n"), F.count_if("readable").alias("n_readable"), F.count_if(F.col("settlement") == "ack").alias("n_acked"), F.count_if(F.col("settlement") == "nack").alias("n_nacked")
    )


KIND = "case when cursor_id = 'global' then 'log' else 'partitioned' end"


@add("decode_cursor", f"""select cursor_id, cursor, case when {KIND} <> 'log' then 'expected cursor kind log, got ' || {KIND} when pos is null then 'cursor payload is unreadable' end as error, case when {KIND} = 'log' then pos end as position, count(*) as n
from (select *, try(json_extract_string("cursor"::json, '$.sequence')::bigint) as pos from offsets) group by all""")
def decode_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Stored cursors as a reader of the plain log decodes them: cursors of another kind and unreadable ones are refused."""
    kind = F.when(F.col("cursor_id") == "global", "log").otherwise("partitioned")
    cursor = F.struct(F.col("cursor_id").alias("id"), kind.alias("kind"), F.base64(F.encode("cursor", "UTF-8")).alias("payload"))
    rows = table(spark, d, "offsets").withColumn("_c", cursor)
    return rows.groupBy("cursor_id", "cursor", E.cursor_error(F.col("_c"), "log").alias("error"), E.decoded_cursor(F.col("_c"), "log").alias("position")).agg(F.count("*").alias("n"))


@add("cursor_round_trip", "select distinct sequence, 'left:global' as id, sequence as position, null::varchar as error from event_log")
def cursor_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Positions encoded under the id of a merge's branch and decoded again."""
    coded = E.encoded_cursor(merge_cursor(F.lit("left"), F.lit("global")), F.lit("log"), F.col("sequence"))
    rows = log(spark, d).select("sequence").distinct().withColumn("c", coded)
    return rows.select("sequence", "c.id", E.decoded_cursor(F.col("c"), "log").alias("position"), E.cursor_error(F.col("c"), "log").alias("error"))


@add("encode_cursor", "select distinct sequence, 'global' as cursor_id, '8' || lpad(hex(sequence), 15, '0') as cursor_order, to_base64(encode('{\"sequence\":' || sequence || '}')) as cursor from event_log")
def encode_cursor(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d).select("sequence").distinct()
    return rows.select("sequence", F.lit("global").alias("cursor_id"), F.hex(E.order_bytes(F.col("sequence"))).alias("cursor_order"), F.base64(F.to_json(F.struct("sequence"))).alias("cursor"))


@add("inspect_counts", "select topic, count(*) as delivered, count(*) filter (content_type = 'application/json') as acked, count(*) filter (content_type <> 'application/json') as nacked from event_log group by topic")
def inspect_counts(spark: SparkSession, d: str) -> DataFrame:
    json = F.col("content_type") == "application/json"
    return log(spark, d).groupBy("topic").agg(F.count("*").alias("delivered"), F.count_if(json).alias("acked"), F.count_if(~json).alias("nacked"))


# ---- partitions ----


def fnv_sql(text: str) -> str:
    """Unsigned hash of a text in SQL."""
    byte = f"('0x' || hex(encode({text}))[2 * i - 1 : 2 * i])::uhugeint"
    return f"list_reduce(list_transform(range(1, octet_length(encode({text})) + 1), lambda i: {byte}), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint, 14695981039346656037::uhugeint)"


SIGNED = "(case when u >= 9223372036854775808 then u::hugeint - 18446744073709551616 else u::hugeint end)::bigint"


@add("fnv1a64", f"select event_key, {SIGNED} as hash from (select event_key, {fnv_sql('event_key')} as u from (select distinct event_key from event_log))")
def fnv1a64_query(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).select("event_key").distinct().select("event_key", fnv1a64(F.col("event_key")).alias("hash"))


@add("partition_assign", f"select sequence, (u % 7)::bigint as p7, (u % 64)::bigint as p64 from (select sequence, {fnv_sql('event_key')} as u from event_log)")
def partition_assign(spark: SparkSession, d: str) -> DataFrame:
    hashed = log(spark, d).select("sequence", fnv1a64(F.col("event_key")).alias("h"))
    return hashed.select("sequence", unsigned_mod(F.col("h"), 7).alias("p7"), unsigned_mod(F.col("h"), 64).alias("p64"))


def resolves(name: str, resolver, text: str) -> None:
    """Register a resolver: rows by partition of 16."""
    sql = f"select partition_id, count(*) as n, max(sequence) as last from (select sequence, (u % 16)::bigint as partition_id from (select sequence, {fnv_sql('k')} as u from (select sequence, {text} as k from event_log) where k is not null)) group by partition_id"

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = partitioning.stamped(log(spark, d), resolver(), 16).where(F.col("partition_id").isNotNull())
        return rows.groupBy("partition_id").agg(F.count("*").alias("n"), F.max("sequence").alias("last"))

    add(name, sql)(query)


resolves("partition_by_org", lambda: partitioning.by_column("organization"), "organization")
resolves("partition_by_namespace", lambda: partitioning.by_column("namespace"), "namespace")
resolves("partition_by_topic", lambda: partitioning.by_column("topic"), "topic")
resolves("partition_by_metadata", lambda: partitioning.by_metadata("region"), "metadata['region']")
resolves("partition_composite", lambda: partitioning.composite([F.col("organization"), F.col("topic")]), "organization || ':' || topic")
scans("select_one", Subscription(StartFrom("earliest"), partitions=Partitions(64, [22])), "where partition_count = 64 and partition_id = 22")
scans("select_many", Subscription(StartFrom("earliest"), partitions=Partitions(64, [1, 7, 30, 63])), "where partition_count = 64 and partition_id in (1, 7, 30, 63)")


@add("null_partition_synthetic", "select sequence, coalesce(partition_id, 0) as partition_id, coalesce(partition_count, 1) as partition_count from event_log")
def null_partition_synthetic(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.decoded(log(spark, d)).select("sequence", "partition_id", "partition_count")


@add("inline_partition", f"select sequence, event_key as partition_key, {SIGNED} as partition_hash, (u % 32)::bigint as partition_id, 32::bigint as partition_count, 'event_key:fnv1a64:v1' as partition_strategy from (select sequence, event_key, {fnv_sql('event_key')} as u from event_log)")
def inline_partition(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.stamped(log(spark, d), F.col("event_key"), 32).select("sequence", *partitioning.STAMPS)


@add("partition_backfill", f"select sequence, coalesce(partition_id, (u % 64)::bigint) as partition_id, coalesce(partition_hash, {SIGNED}) as partition_hash, coalesce(partition_count, 64) as partition_count from (select *, {fnv_sql('event_key')} as u from event_log)")
def partition_backfill(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.backfilled(log(spark, d), F.col("event_key"), 64).select("sequence", "partition_id", "partition_hash", "partition_count")


@add("backfill_report", "select count(*) filter (partition_id is null) as rows_updated, ceil(count(*) filter (partition_id is null) / 16.0)::bigint as batches from event_log")
def backfill_report(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.backfill_report(log(spark, d), 16)


KEYED = "(select distinct sequence, partition_id from event_log where partition_id is not null)"


@add("lane_jam", f"""with k as (select organization, sequence, partition_id % 8 as lane, row_number() over (partition by organization, partition_id % 8 order by sequence) as place from (select distinct organization, sequence, partition_id from event_log where partition_id is not null)),
f as (select organization, lane, min(sequence) filter (place = 64) as filled, min(sequence) filter (place = 65) as over from k group by all having max(place) >= 64)
select organization, min(over) as stalled_at, coalesce(count(*) = 8 and max(filled) < min(over), false) as jammed from f group by organization""")
def lane_jam(spark: SparkSession, d: str) -> DataFrame:
    """Where intake into 8 lanes of 64 rows stalls if no handler settles anything, and whether it does with all lanes full."""
    rows = log(spark, d).where("partition_id is not null").select("organization", "sequence", "partition_id").distinct()
    return partitioning.jams(rows.withColumn("lane", F.col("partition_id") % 8), "lane", 8, 64, ["organization"])


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows with a partition, one for each sequence."""
    return log(spark, d).where(F.col("partition_id").isNotNull()).select("sequence", "partition_id", "partition_count").distinct()


@add("lane_order", f"select sequence, partition_id % 8 as lane, row_number() over (partition by partition_id % 8 order by sequence) as place from {KEYED}")
def lane_order(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.laned(keyed(spark, d), F.col("partition_id") % 8).select("sequence", "lane", "place")


@add("lane_from_column", f"select sequence, partition_id as lane, row_number() over (partition by partition_id order by sequence) as place from {KEYED}")
def lane_from_column(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.lane_of_partition(keyed(spark, d), 64).select("sequence", "lane", "place")


@add("lane_round_robin", f"select sequence, lane, row_number() over (order by place, (lane + 7) % 8) as position from (select sequence, partition_id % 8 as lane, row_number() over (partition by partition_id % 8 order by sequence) as place from {KEYED})")
def lane_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.round_robin(keyed(spark, d), F.col("partition_id") % 8, 8).select("sequence", "lane", "position")


# ---- scalar functions ----

NS = "case when namespace in ('', '/') then '/' when starts_with(namespace, '/') then namespace else '/' || namespace end"


@add("namespace_functions", f"select ns, case when ns = '/' then null when regexp_replace(ns, '/[^/]*$', '') = '' then '/' else regexp_replace(ns, '/[^/]*$', '') end as parent, case when ns = '/' then 0 else length(ns) - length(replace(ns, '/', '')) end::integer as depth, ns = '/' as is_root, case when ns = '/' then '/eu' else '/eu' || ns end as scoped, (ns = '/shop' or starts_with(ns, '/shop/')) as in_shop, count(*) as n from (select {NS} as ns from event_log) group by ns")
def namespace_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d).groupBy(E.namespace_of(F.col("namespace")).alias("ns")).agg(F.count("*").alias("n"))
    ns = F.col("ns")
    return rows.select("ns", E.namespace_parent(ns).alias("parent"), E.namespace_depth(ns).alias("depth"), (ns == "/").alias("is_root"), E.namespace_scoped(ns, "/eu").alias("scoped"), E.namespace_within(ns, "/shop").alias("in_shop"), "n")


@add("validate_envelope", """select coalesce(case
  when not coalesce(regexp_full_match(organization, '[a-z0-9_-]+'), false) then 'organization'
  when not coalesce(regexp_full_match(namespace, '/|(/[A-Za-z0-9_-]+)+'), false) then 'namespace'
  when not coalesce(regexp_full_match(topic, '[a-z0-9_-]+(\\.[a-z0-9_-]+)*'), false) then 'topic'
  when not coalesce(octet_length(encode(event_key)) between 1 and 1024, false) then 'key'
  when not coalesce(content_type in ('application/json', 'text/plain', 'application/octet-stream'), false) then 'content_type'
  when len(list_filter(map_keys(metadata), lambda k: not regexp_full_match(k, '[A-Za-z0-9]([A-Za-z0-9_.:/-]*[A-Za-z0-9])?') or octet_length(encode(k)) > 128)) > 0 then 'metadata_key'
  end, 'valid') as verdict, count(*) as n from event_log group by verdict""")
def validate_envelope(spark: SparkSession, d: str) -> DataFrame:
    error = E.envelope_error(F.col("organization"), F.col("namespace"), F.col("topic"), F.col("event_key"), F.col("content_type"), F.col("metadata"))
    return log(spark, d).groupBy(F.coalesce(error, F.lit("valid")).alias("verdict")).agg(F.count("*").alias("n"))


@add("payload_size", f"select topic, sum(octet_length(encode(payload)))::bigint as bytes, count(*) filter ({READABLE}) as n_json from event_log group by topic")
def payload_size(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("topic").agg(F.sum(F.octet_length("payload")).alias("bytes"), F.count_if(E.is_object(F.col("payload"))).alias("n_json"))


@add("payload_base64", "select sequence, to_base64(encode(event_key)) as coded, event_key as back from event_log")
def payload_base64(spark: SparkSession, d: str) -> DataFrame:
    coded = F.base64(F.encode("event_key", "UTF-8"))
    return log(spark, d).select("sequence", coded.alias("coded"), F.decode(F.unbase64(coded), "UTF-8").alias("back"))


@add("timestamp_roundtrip", "select sequence, strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%fZ') as text, \"timestamp\" as back from event_log")
def timestamp_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    text = E.rfc3339(F.col("timestamp"))
    return log(spark, d).select("sequence", text.alias("text"), E.from_rfc3339(text).alias("back"))
