"""Queries of stateful operators, handlers, stores and sinks over the stored event log and its state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import envelope as E
from seqloom.functions.ids import event_key_of, uuid_key, uuid_text
from seqloom.operators import filters, folds, handlers, sinks, stateful, stores
from seqloom.operators.filters import EventFilter
from seqloom.operators.handlers import Route
from seqloom.plans.registry import Registry
from seqloom.plans.sql import uuid_sql
from seqloom.sources.tables import first_rows, table

registry = Registry()
add = registry.add

COLUMNS = ["sequence", "id", "organization", "namespace", "topic", "event_key", "timestamp", "version", "content_type", "correlation_id", "partition_id"]
ROWS = f"(select distinct {', '.join(COLUMNS)} from event_log)"
"""Stored rows in SQL, one for each sequence."""


def rows(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Stored rows, one for each sequence: rows of equal sequence are equal. Only the ``columns`` named, if any, are read and moved."""
    return table(spark, d, "event_log").select("sequence", *columns).distinct() if columns else table(spark, d, "event_log").select(*COLUMNS).distinct()


def numbers(spark: SparkSession, d: str) -> DataFrame:
    """The stored sequences, each once."""
    return table(spark, d, "event_log").select("sequence").distinct()


FIRST = f"(select * from (select *, row_number() over (partition by {uuid_sql('id')} order by sequence) as _n from {ROWS}) where _n = 1)"

# ---- de-duplication ----


@add("dedupe_by_id", f"select {uuid_sql('id')} as event, sequence, topic from {FIRST}")
def dedupe_by_id(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "event_log"), topic=F.col("topic")).select(F.lower(F.hex("event")).alias("event"), "sequence", "topic")


@add("dedupe_against_store", f"select sequence, id from {ROWS} where {uuid_sql('id')} not in (select {uuid_sql('event_id')} from dedupe where {uuid_sql('event_id')} is not null)")
def dedupe_against_store(spark: SparkSession, d: str) -> DataFrame:
    return stateful.against_store(rows(spark, d, "id"), table(spark, d, "dedupe")).select("sequence", "id")


# repeats only: `skipped` holds the places of those left out so far; a repeat is left out if fewer than 1,000 rows were delivered since its event last was
BOUNDED = f"""with recursive r as (select organization, sequence, row_number() over (partition by organization order by sequence) as rn, {uuid_sql('id')} as event from {ROWS}),
o as (select *, list(rn) over (partition by organization, event order by rn rows between unbounded preceding and 1 preceding) as before from r where event is not null),
c as (select *, row_number() over (partition by organization order by rn) as i from o where len(before) > 0),
w as (select organization, 0::bigint as i, []::bigint[] as skipped from (select distinct organization from c)
  union all
  select w.organization, c.i, case when c.rn - 1 - len(w.skipped) - (list_max(list_filter(c.before, lambda x: not list_contains(w.skipped, x))) - len(list_filter(w.skipped, lambda x: x < list_max(list_filter(c.before, lambda y: not list_contains(w.skipped, y)))))) < 1000
    then list_append(w.skipped, c.rn) else w.skipped end
  from w join c on c.organization = w.organization and c.i = w.i + 1)
select r.organization, r.sequence, not coalesce(list_contains(s.skipped, r.rn), false) as delivered from r left join (select organization, arg_max(skipped, i) as skipped from w group by organization) s using (organization)"""


@add("dedupe_bounded", BOUNDED)
def dedupe_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Bounded first-in, first-out memory of 1,000 ids per organization."""
    return folds.fold(rows(spark, d, "id", "organization"), {"organization": F.col("organization")}, {"event": F.hex(event_key_of(F.col("id")))}, folds.bounded_memory(1000), {"delivered": "boolean"})


# ---- monotone gate ----

GATE = "\"timestamp\" > max(\"timestamp\") over (%s order by sequence rows between unbounded preceding and 1 preceding)"


def gate_sql(keys: str) -> str:
    return f"select sequence, organization, \"timestamp\" from (select *, coalesce({GATE % keys}, true) as _ok from {ROWS}) where _ok"


@add("watermark_monotone", gate_sql(""))
def watermark_monotone(spark: SparkSession, d: str) -> DataFrame:
    return stateful.monotone_gate(rows(spark, d, "organization", "timestamp")).select("sequence", "organization", "timestamp")


@add("watermark_per_key", gate_sql("partition by organization"))
def watermark_per_key(spark: SparkSession, d: str) -> DataFrame:
    return stateful.monotone_gate(rows(spark, d, "organization", "timestamp"), keys=["organization"]).select("sequence", "organization", "timestamp")


@add("watermark_resume", f"""with stored as (select regexp_extract(key, '^([a-z0-9_-]+)@[0-9]+$', 1) as organization, max(ts) as watermark from watermarks where regexp_full_match(key, '[a-z0-9_-]+@[0-9]+') group by 1)
select sequence, organization, "timestamp" from (
  select l.*, greatest(max(l."timestamp") over (partition by l.organization order by l.sequence rows between unbounded preceding and 1 preceding), s.watermark) as mark
  from {ROWS} l left join stored s using (organization)) where mark is null or "timestamp" > mark""")
def watermark_resume(spark: SparkSession, d: str) -> DataFrame:
    """A reader that loads each organization's stored watermark first."""
    form = r"^([a-z0-9_-]+)@[0-9]+$"
    stored = table(spark, d, "watermarks").where(F.col("key").rlike(form)).groupBy(F.regexp_extract("key", form, 1).alias("organization")).agg(F.max("ts").alias("watermark"))
    return stateful.monotone_gate(rows(spark, d, "organization", "timestamp"), keys=["organization"], initial=stored).select("sequence", "organization", "timestamp")


# ---- batches, windows, merges ----

BATCHED = f"(select *, (rn - 1) // 64 as batch, ((rn - 1) % 64)::integer as idx from (select *, row_number() over (order by sequence) as rn from {ROWS}))"


@add("batch_by_count", f"select sequence, batch, idx from {BATCHED}")
def batch_by_count(spark: SparkSession, d: str) -> DataFrame:
    return stateful.batched(numbers(spark, d), 64).select("sequence", "batch", "idx")


@add("batch_ack_subset", f"select sequence, batch, idx, idx in (0, 3, 63) as settled from {BATCHED}")
def batch_ack_subset(spark: SparkSession, d: str) -> DataFrame:
    return stateful.settle_subset(stateful.batched(numbers(spark, d), 64), 64, [0, 3, 63]).select("sequence", "batch", "idx", "settled")


@add("batch_cursor", f"select batch, arg_min(id, idx) as cursor_id, arg_max(sequence, idx) as cursor_order from {BATCHED} group by batch")
def batch_cursor(spark: SparkSession, d: str) -> DataFrame:
    return stateful.batch_cursors(stateful.batched(rows(spark, d, "id"), 64))


@add("window_size_or_wait", f"""with recursive r as (
  select event_key, sequence, epoch_us("timestamp") as us, row_number() over (partition by event_key order by sequence) as rn from {ROWS}),
w as (
  select event_key, sequence, rn, 0::bigint as number, 1 as n, us as opened from r where rn = 1
  union all
  select r.event_key, r.sequence, r.rn,
    w.number + (w.n >= 10 or r.us > w.opened + 21600000000)::integer,
    case when w.n >= 10 or r.us > w.opened + 21600000000 then 1 else w.n + 1 end,
    case when w.n >= 10 or r.us > w.opened + 21600000000 then r.us else w.opened end
  from w join r on r.event_key = w.event_key and r.rn = w.rn + 1)
select event_key, sequence, number as window_no from w""")
def window_size_or_wait(spark: SparkSession, d: str) -> DataFrame:
    """Micro-windows of 10 rows or 6 hours per event key, on event time."""
    wait = 6 * 3600 * 1_000_000
    return folds.fold(rows(spark, d, "event_key", "timestamp"), {"event_key": F.col("event_key")}, {"us": F.unix_micros(F.col("timestamp").cast("timestamp"))}, folds.windows(10, wait), {"window_no": "bigint"})


LEFT, RIGHT = f"(select sequence from {ROWS})", "(select event_id + 1 as sequence from events)"


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two logs: the stored one and the other event stream."""
    return numbers(spark, d), table(spark, d, "events").select((F.col("event_id") + 1).alias("sequence"))


def merges(name: str, weights: tuple[int, int] | None) -> None:
    key = "side, i" if weights is None else f"(i - 1) // (case side when 'left' then {weights[0]} else {weights[1]} end), side, i"
    both = f"select 'left' as side, sequence, row_number() over (order by sequence) as i from {LEFT} union all select 'right', sequence, row_number() over (order by sequence) from {RIGHT}"
    add(name, f"select side, sequence, row_number() over (order by {key}) as position from ({both})")(lambda spark, d: stateful.merged(*sides(spark, d), weights).select("side", "sequence", "position"))


merges("merge_fair", (1, 1))
merges("merge_left_priority", None)
merges("merge_weighted", (3, 2))


@add("merge_cursor_ids", "select 'left:' || cursor_id as left_id, 'right:' || cursor_id as right_id, count(*) as n from offsets group by cursor_id")
def merge_cursor_ids(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "offsets").groupBy("cursor_id").agg(F.count("*").alias("n"))
    return by.select(stateful.merge_cursor(F.lit("left"), F.col("cursor_id")).alias("left_id"), stateful.merge_cursor(F.lit("right"), F.col("cursor_id")).alias("right_id"), "n")


HISTORY, LIVE = (f"(select max(sequence) * {tenths} // 10 from event_log)" for tenths in (6, 4))
"""History ends behind the start of the live stream; what lies between is in both."""


def share(spark: SparkSession, d: str, tenths: int) -> int:
    """So many tenths of the log's last sequence."""
    return (table(spark, d, "event_log").agg(F.max("sequence")).head()[0] or 0) * tenths // 10


def phases(spark: SparkSession, d: str, dedupe: bool) -> DataFrame:
    all_rows = rows(spark, d, "id")
    history, live = (all_rows.where(c).select("sequence", "id") for c in (F.col("sequence") <= share(spark, d, 6), F.col("sequence") > share(spark, d, 4)))
    return stateful.replay_then_live(history, live, dedupe=dedupe).select("sequence", "id", "phase")


@add("replay_then_live", f"with h as (select sequence, id from {ROWS} where sequence <= {HISTORY}) select *, 'replay' as phase from h union all select sequence, id, 'live' from {ROWS} where sequence > {LIVE} and {uuid_sql('id')} not in (select {uuid_sql('id')} from h)")
def replay_then_live(spark: SparkSession, d: str) -> DataFrame:
    return phases(spark, d, True)


@add("replay_no_dedupe", f"select sequence, id, 'replay' as phase from {ROWS} where sequence <= {HISTORY} union all select sequence, id, 'live' from {ROWS} where sequence > {LIVE}")
def replay_no_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return phases(spark, d, False)


# ---- schedules, deadlines, routes ----


@add("rate_schedule", f"select sequence, (row_number() over (order by sequence) - 1) * 1000000 // 300 as release_us from {ROWS}")
def rate_schedule(spark: SparkSession, d: str) -> DataFrame:
    return stateful.release_times(numbers(spark, d), 300).select("sequence", "release_us")


DONE = f"(select {uuid_sql('event_id')} as event, subscriber_id, min(completed_at) as acked_at from multiplexer_completions where {uuid_sql('event_id')} is not null group by 1, 2)"


@add("delivery_expired", f"select f.sequence, d.subscriber_id, coalesce(d.acked_at > f.\"timestamp\" + interval 4 hours, true) as expired from {FIRST} f left join {DONE} d on {uuid_sql('f.id')} = d.event")
def delivery_expired(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "multiplexer_completions").select(uuid_key(F.col("event_id")).alias("event"), "subscriber_id", "completed_at").where("event is not null")
    done = done.groupBy("event", "subscriber_id").agg(F.min("completed_at").alias("acked_at"))
    made = first_rows(table(spark, d, "event_log"), delivered_at=F.col("timestamp"))
    return stateful.expired(made.join(done, "event", "left"), "4 hours").select("sequence", "subscriber_id", "expired")


JSON = "content_type = 'application/json'"


def routes_of(spark: SparkSession, d: str, **policy: bool) -> DataFrame:
    return stateful.routed(rows(spark, d, "content_type", "topic"), F.col("content_type") == "application/json", F.col("topic") != "payment.settled", **policy)


@add("route_acked", f"select sequence, topic from {ROWS} where {JSON}")
def route_acked(spark: SparkSession, d: str) -> DataFrame:
    return routes_of(spark, d).where("route = 'acked'").select("sequence", "topic")


@add("route_nacked", f"select sequence, topic from {ROWS} where not {JSON}")
def route_nacked(spark: SparkSession, d: str) -> DataFrame:
    return routes_of(spark, d).where("route = 'nacked'").select("sequence", "topic")


@add("route_disposition", f"select sequence, case when topic = 'payment.settled' then 'route_failed' when {JSON} then 'acked' else 'nacked' end as required, 'acked' as after_route from {ROWS}")
def route_disposition(spark: SparkSession, d: str) -> DataFrame:
    required = routes_of(spark, d).withColumnRenamed("disposition", "required").drop("route")
    return stateful.routed(required, F.col("content_type") == "application/json", F.col("topic") != "payment.settled", ack_after_route=True, require_route=False).select("sequence", "required", F.col("disposition").alias("after_route"))


# ---- handlers ----

TAKES_MS, NEEDS = "octet_length(encode(event_key)) * 10", "(octet_length(encode(event_key)) % 5 + 1)"


def takes_ms():
    return F.octet_length("event_key") * 10


def needs():
    return F.octet_length("event_key") % 5 + 1


@add("handler_outcome", f"select sequence, case when {JSON} then 'ok' else 'error' end as outcome from {ROWS}")
def handler_outcome(spark: SparkSession, d: str) -> DataFrame:
    return handlers.handled(rows(spark, d, "content_type"), F.col("content_type") == "application/json").select("sequence", "outcome")


@add("handler_filtered", f"select sequence, case when topic = 'inventory.adjusted' and not {JSON} then 'error' else 'ok' end as outcome from {ROWS}")
def handler_filtered(spark: SparkSession, d: str) -> DataFrame:
    return handlers.handled(rows(spark, d, "content_type", "topic"), F.col("content_type") == "application/json", only=EventFilter(topic="inventory.adjusted")).select("sequence", "outcome")


@add("handler_timeout", f"select sequence, case when {TAKES_MS} > 150 then 'timeout' when {JSON} then 'ok' else 'error' end as outcome from {ROWS}")
def handler_timeout(spark: SparkSession, d: str) -> DataFrame:
    return handlers.handled(rows(spark, d, "content_type", "event_key"), F.col("content_type") == "application/json", duration_ms=takes_ms(), timeout_ms=150).select("sequence", "outcome")


@add("consumer_outcomes", f"select topic, outcome, count(*) as n from (select topic, case when {TAKES_MS} > 150 then 'handler_timeout' when {JSON} then 'ack' else 'handler_error' end as outcome from {ROWS}) group by all")
def consumer_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What a consumer settles: ack, or nack with the reason."""
    done = handlers.handled(rows(spark, d, "content_type", "topic", "event_key"), F.col("content_type") == "application/json", duration_ms=takes_ms(), timeout_ms=150)
    reason = F.when(F.col("outcome") == "ok", "ack").when(F.col("outcome") == "timeout", "handler_timeout").otherwise("handler_error")
    return done.groupBy("topic", reason.alias("outcome")).agg(F.count("*").alias("n"))


@add("retry_attempts", f"select sequence, a::integer as attempt, case when a = need then 'ok' when a >= 3 then 'dead_letter' else 'retry' end as state, case when a < need and a < 3 then least(100.0::double * pow(2.0, a - 1), 30000.0) end as delay_ms from (select sequence, need, unnest(range(1, least(need, 3) + 1)) as a from (select sequence, {NEEDS} as need from {ROWS}))")
def retry_attempts(spark: SparkSession, d: str) -> DataFrame:
    return handlers.attempts(rows(spark, d, "event_key"), needs()).select("sequence", "attempt", "state", "delay_ms")


@add("retry_policy", f"""select topic, attempt, state, count(*) as n from (
  select topic, a::integer as attempt, case when a = need then 'ok' when content_type = 'text/plain' then 'skip' when content_type <> 'application/json' then 'dead_letter' when a >= 3 then 'dead_letter' else 'retry' end as state
  from (select topic, content_type, need, unnest(range(1, case when content_type = 'application/json' then least(need, 3) else 1 end + 1)) as a from (select topic, content_type, {NEEDS} as need from {ROWS}))) group by all""")
def retry_policy(spark: SparkSession, d: str) -> DataFrame:
    """Failures of plain texts are skipped and of binary payloads dead letters at once; only JSON is tried again."""
    policy = F.when(F.col("content_type") == "text/plain", "skip").when(F.col("content_type") != "application/json", "dead_letter")
    return handlers.attempts(rows(spark, d, "event_key", "topic", "content_type"), needs(), policy=policy).groupBy("topic", "attempt", "state").agg(F.count("*").alias("n"))


@add("retry_final_state", f"select sequence, least({NEEDS}, 3)::integer as attempts, case when {NEEDS} <= 3 then 'ok' else 'dead_letter' end as state from {ROWS}")
def retry_final_state(spark: SparkSession, d: str) -> DataFrame:
    return handlers.final_state(rows(spark, d, "event_key"), needs()).select("sequence", "attempts", "state")


@add("retry_backoff", f"select sequence, least(100.0::double * pow(2.0, {NEEDS} * 3 - 1), 30000.0) as delay_ms from {ROWS}")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d, "event_key").select("sequence", E.backoff_ms(needs() * 3).alias("delay_ms"))


# an id of version 7: milliseconds, then digits of the original's id, handler and attempt
DEAD_ID = """(lower(substr(lpad(hex(epoch_us("timestamp") // 1000), 12, '0'), 1, 8)) || '-' || lower(substr(lpad(hex(epoch_us("timestamp") // 1000), 12, '0'), 9, 4)) || '-7' || substr(m, 1, 3) || '-'
  || substr('89ab', ('0x' || substr(m, 4, 1))::integer % 4 + 1, 1) || substr(m, 5, 3) || '-' || substr(m, 8, 12))"""


@add("dead_letter_events", f"select {DEAD_ID} as id, organization, namespace, topic || '.dead_letter' as topic, event_key, id as parent_id, correlation_id, id as original_event_id, 'indexer' as handler_id, 3 as attempts, 'still failing' as error, topic as original_topic, content_type as original_type, producer from (select distinct {', '.join(COLUMNS)}, md5(id || ':indexer:3') as m, metadata['producer'] as producer from event_log where {NEEDS} > 3)")
def dead_letter_events(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "event_log")
    failed = log.dropDuplicates(["sequence"]).where(needs() > 3)
    made = handlers.dead_letters(failed, "indexer", F.lit(3), F.lit("still failing"), F.col("timestamp"))
    told = F.from_json("payload", "original_event struct<topic:string,payload:struct<content_type:string>,metadata:map<string,string>>, original_event_id string, handler_id string, attempts int, error string")
    envelope = ["id", "organization", "namespace", "topic", "event_key", "parent_id", "correlation_id"]
    return made.select(*envelope, told.alias("p")).select(
        *envelope, "p.original_event_id", "p.handler_id", "p.attempts", "p.error", F.col("p.original_event.topic").alias("original_topic"),
        F.col("p.original_event.payload.content_type").alias("original_type"), F.try_element_at("p.original_event.metadata", F.lit("producer")).alias("producer"),
    )


ROUTES = [
    Route("ledger", filters.any_of(EventFilter(topic="payment.settled"), EventFilter(topic="invoice.issued"))),
    Route("mailer", EventFilter(topic="order.submitted")),
    Route("archive", EventFilter(organization="brightmoor")),
    Route("audit.sink", EventFilter(namespace="/billing")),
    Route("webhooks:eu", EventFilter(namespace="/shop/orders")),
]
MATCHES = f"""(select sequence, id, version, content_type, unnest(list_filter([
  case when topic in ('payment.settled', 'invoice.issued') then 'ledger' end, case when topic = 'order.submitted' then 'mailer' end, case when organization = 'brightmoor' then 'archive' end,
  case when namespace = '/billing' or starts_with(namespace, '/billing/') then 'audit.sink' end, case when namespace = '/shop/orders' or starts_with(namespace, '/shop/orders/') then 'webhooks:eu' end], lambda x: x is not null)) as subscriber_id from {ROWS})"""


@add("multiplex_matches", f"select sequence, subscriber_id from {MATCHES}")
def multiplex_matches(spark: SparkSession, d: str) -> DataFrame:
    return handlers.multiplexed(rows(spark, d), ROUTES).select("sequence", "subscriber_id")


@add("multiplex_resume", f"select sequence, subscriber_id from {MATCHES} m where not exists (select 1 from {DONE} d where d.event = {uuid_sql('m.id')} and d.subscriber_id = m.subscriber_id)")
def multiplex_resume(spark: SparkSession, d: str) -> DataFrame:
    return handlers.remaining(handlers.multiplexed(rows(spark, d), ROUTES), table(spark, d, "multiplexer_completions")).select("sequence", "subscriber_id")


@add("multiplex_unmatched", f"select sequence, topic from {ROWS} where sequence not in (select sequence from {MATCHES})")
def multiplex_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return handlers.unmatched(rows(spark, d), ROUTES).select("sequence", "topic")


@add("multiplex_no_match", f"select sequence, topic, 'handler_error' as outcome from {ROWS} where sequence not in (select sequence from {MATCHES})")
def multiplex_no_match(spark: SparkSession, d: str) -> DataFrame:
    """Rows without subscriber where the policy calls that an error."""
    return handlers.unmatched_outcome(rows(spark, d), ROUTES, "error").select("sequence", "topic", "outcome")


@add("multiplex_ack", f"select sequence, count(*) as n_subscribers, count(*) filter (not (version < 4 or subscriber_id = 'archive')) as n_failed, bool_and(version < 4 or subscriber_id = 'archive') as acked from {MATCHES} group by sequence")
def multiplex_ack(spark: SparkSession, d: str) -> DataFrame:
    return handlers.acknowledged(handlers.multiplexed(rows(spark, d), ROUTES), (F.col("version") < 4) | (F.col("subscriber_id") == "archive"))


@add("work_enqueue", f"select sequence, subscriber_id, 0 as attempts from {MATCHES}")
def work_enqueue(spark: SparkSession, d: str) -> DataFrame:
    return handlers.work_items(rows(spark, d), ROUTES).select("sequence", "subscriber_id", "attempts")


# ---- stores ----

AS_OF = "2031-03-16 00:00:00"


@add("checkpoint_resume", f"""with said as (select consumer_group_id, stream_id, max((('0x' || hex(cursor_order))::uhugeint::hugeint - 9223372036854775808)::bigint) as pos from offsets where cursor_id = 'global' and octet_length(cursor_order) = 8 group by all)
select consumer_group_id, stream_id, count(*) as n, min(sequence) as first from said join {ROWS} on sequence > pos group by all""")
def checkpoint_resume(spark: SparkSession, d: str) -> DataFrame:
    """What each reader with a global cursor still has before it: rows are counted in blocks of sequences, and only the cursor's own block row by row."""
    marks = stores.monotone_checkpoints(table(spark, d, "offsets")).where("cursor_id = 'global'").select(*stores.SCOPE, "position")
    return stores.remaining_counts(numbers(spark, d), marks, "position")


@add("snapshot_latest", f"select event_key, arg_max(topic, sequence) as topic, arg_max(version, sequence) as version, max(sequence) as sequence from {ROWS} group by event_key")
def snapshot_latest(spark: SparkSession, d: str) -> DataFrame:
    """State of each key after its latest row, and the row it covers."""
    return stores.snapshots(rows(spark, d, "event_key", "topic", "version"), ["event_key"], ["topic", "version"])


ACKED = f"(select l.sequence, l.partition_id, {uuid_sql('l.id')} in (select {uuid_sql('event_id')} from dedupe where {uuid_sql('event_id')} is not null) as acked from {ROWS} l where l.partition_id is not null)"


def acked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a partition and whether the store of processed ids has their event."""
    done = table(spark, d, "dedupe").select(uuid_key(F.col("event_id")).alias("event")).where("event is not null").distinct().withColumn("acked", F.lit(True))
    return rows(spark, d, "partition_id", "id").where("partition_id is not null").select("sequence", "partition_id", uuid_key(F.col("id")).alias("event")).join(done, "event", "left").select("sequence", "partition_id", F.coalesce("acked", F.lit(False)).alias("acked"))


@add("checkpoint_contiguous", f"with a as {ACKED}, f as (select partition_id, min(sequence) filter (not acked) as open from a group by all) select a.partition_id, max(a.sequence) filter (f.open is null or a.sequence < f.open) as checkpoint from a join f using (partition_id) group by a.partition_id")
def checkpoint_contiguous(spark: SparkSession, d: str) -> DataFrame:
    return stores.contiguous(acked_rows(spark, d), F.col("acked"), ["partition_id"])


@add("checkpoint_flush_points", f"select partition_id, rn // 50 as flush, sequence from (select sequence, partition_id, row_number() over (partition by partition_id order by sequence) as rn from {ACKED} where acked) where rn % 50 = 0")
def checkpoint_flush_points(spark: SparkSession, d: str) -> DataFrame:
    return stores.flush_points(acked_rows(spark, d).where("acked"), 50, ["partition_id"])


@add("resume_or_initial", """with p as (select consumer_group_id, stream_id, cursor_id, max(case when octet_length(cursor_order) = 8 then (('0x' || hex(cursor_order))::uhugeint::hugeint - 9223372036854775808)::bigint
  else try_cast(trim(json_extract_string(case when json_valid("cursor") then "cursor" end, '$.sequence')) as bigint) end) as pos from offsets group by all)
select consumer_group_id, stream_id, case when bool_or(pos is null) then 0 else min(pos) end as start from p group by all""")
def resume_or_initial(spark: SparkSession, d: str) -> DataFrame:
    """Where readers start if an unreadable cursor means the initial start."""
    return stores.resume_or_initial(table(spark, d, "offsets"))


PENDING = f"with a as {ACKED}, f as (select partition_id, min(sequence) as open from a where not acked group by all), w as (select a.partition_id, open, sequence, row_number() over (partition by a.partition_id order by sequence) as rn from a join f on a.partition_id = f.partition_id and sequence >= open)"


@add("pending_limit", f"{PENDING} select partition_id, open, count(*) as pending, min(sequence) filter (rn > 64) as stopped_at from w group by all")
def pending_limit(spark: SparkSession, d: str) -> DataFrame:
    """Partitions whose oldest row isn't acked, and where a reader that lets 64 rows wait for it stops."""
    return stores.pending_stops(acked_rows(spark, d), F.col("acked"), ["partition_id"], 64)


def flush_sql(keys: str, source: str, order: str, count: int, interval: int) -> str:
    """Flushes by count, interval and at the end, of (keys, ord, position, us) in ``source``."""
    return f"""with recursive r as (select *, row_number() over (partition by {keys} order by {order}) as rn, count(*) over (partition by {keys}) as total from {source}),
w as (
  select {keys}, rn, total, 1 as waiting, us as first, position as top, case when {count} <= 1 or {interval} <= 0 then 'count' when rn = total then 'end' end as cause from r where rn = 1
  union all
  select r.{keys}, r.rn, r.total, case when w.cause is null then w.waiting + 1 else 1 end, case when w.cause is null then w.first else r.us end, case when w.cause is null then greatest(w.top, r.position) else r.position end,
    case when case when w.cause is null then w.waiting + 1 else 1 end >= {count} then 'count' when r.us - case when w.cause is null then w.first else r.us end >= {interval} then 'interval' when r.rn = r.total then 'end' end
  from w join r on r.{keys} = w.{keys} and r.rn = w.rn + 1)
select {keys}, top as position, cause from w where cause is not null"""


HOUR = 3_600_000_000


@add("checkpoint_flush_interval", flush_sql("partition_id", f"(select partition_id, sequence as position, epoch_us(\"timestamp\") as us from {ROWS} where partition_id is not null)", "position", 20, 12 * HOUR))
def checkpoint_flush_interval(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints of each partition at every 20th ack, at the first that comes 12 hours after the first that waits, and at the end."""
    acks = rows(spark, d, "partition_id", "timestamp").where("partition_id is not null")
    made = folds.fold(acks, {"partition_id": F.col("partition_id")}, {"p": F.col("sequence"), "us": F.unix_micros(F.col("timestamp").cast("timestamp"))}, folds.flushes(20, 12 * HOUR), {"position": "bigint", "cause": "string"}, many=True)
    return made.select("partition_id", "position", "cause")


@add("coordinated_flush", flush_sql("partition_id", f"(select partition_id, sequence as position, epoch_us(\"timestamp\") as us from {ROWS} where partition_id is not null)", "us, position", 50, 24 * HOUR))
def coordinated_flush(spark: SparkSession, d: str) -> DataFrame:
    """Owners' checkpoints where acks come in another order than rows: the greatest position of those that wait is flushed, by count, by interval and on release."""
    acks = rows(spark, d, "partition_id", "timestamp").where("partition_id is not null").withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp")))
    made = folds.fold(acks, {"partition_id": F.col("partition_id")}, {"p": F.col("sequence"), "at": F.col("us")}, folds.flushes(50, 24 * HOUR), {"position": "bigint", "cause": "string"}, order="us", many=True)
    return made.select("partition_id", "position", "cause")


@add("buffer_pending", f"select sequence as id, topic from {FIRST} where {uuid_sql('id')} not in (select {uuid_sql('event_id')} from dedupe where {uuid_sql('event_id')} is not null)")
def buffer_pending(spark: SparkSession, d: str) -> DataFrame:
    """Buffer entries pushed but not acked, in push order."""
    pushed = first_rows(table(spark, d, "event_log"), topic=F.col("topic"))
    pushed = pushed.select("sequence", "topic", uuid_text(F.col("event")).alias("event"))
    return stateful.against_store(pushed, table(spark, d, "dedupe"), id_column="event").select(F.col("sequence").alias("id"), "topic")


@add("buffer_replay", f"select sequence, topic, case when sequence <= {HISTORY} then 'pending' else 'live' end as phase from {FIRST} where sequence > {HISTORY} or {uuid_sql('id')} not in (select {uuid_sql('event_id')} from dedupe where {uuid_sql('event_id')} is not null)")
def buffer_replay(spark: SparkSession, d: str) -> DataFrame:
    """Entries left over from before come first, then live rows."""
    pushed, history = first_rows(table(spark, d, "event_log"), topic=F.col("topic")).select("sequence", "topic", uuid_text(F.col("event")).alias("event")), share(spark, d, 6)
    before = stateful.against_store(pushed.where(F.col("sequence") <= history), table(spark, d, "dedupe"), id_column="event")
    return before.withColumn("phase", F.lit("pending")).unionByName(pushed.where(F.col("sequence") > history).withColumn("phase", F.lit("live"))).select("sequence", "topic", "phase")


CLAIMS = f"(select m.sequence, m.subscriber_id, d.acked_at as claimed_until from {MATCHES} m left join {DONE} d on d.event = {uuid_sql('m.id')} and d.subscriber_id = m.subscriber_id)"


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Work items; a recorded completion time serves as the end of a claim."""
    done = table(spark, d, "multiplexer_completions").select(uuid_key(F.col("event_id")).alias("event"), "subscriber_id", "completed_at").where("event is not null").groupBy("event", "subscriber_id").agg(F.min("completed_at").alias("claimed_until"))
    items = handlers.multiplexed(rows(spark, d), ROUTES).withColumn("event", uuid_key(F.col("id")))
    return items.join(done, ["event", "subscriber_id"], "left").select("sequence", "subscriber_id", "claimed_until", F.lit(0).alias("attempts"))


@add("claim_batch", f"select sequence, 1 as attempts from (select sequence, min(claimed_until) as claimed_until from {CLAIMS} where subscriber_id = 'archive' group by sequence) where claimed_until is null or claimed_until < timestamp '{AS_OF}' order by sequence limit 100")
def claim_batch(spark: SparkSession, d: str) -> DataFrame:
    items = claims(spark, d).where("subscriber_id = 'archive'").groupBy("sequence").agg(F.min("claimed_until").alias("claimed_until"), F.min("attempts").alias("attempts"))
    return stores.claim(items, AS_OF, 100, order="sequence").select("sequence", "attempts")


@add("work_claim", f"select sequence, subscriber_id, 1 as attempts from (select *, row_number() over (partition by subscriber_id order by sequence) as _n from {CLAIMS} where claimed_until is null or claimed_until < timestamp '{AS_OF}') where _n <= 20")
def work_claim(spark: SparkSession, d: str) -> DataFrame:
    return stores.claim(claims(spark, d), AS_OF, 20, order="sequence", per=["subscriber_id"]).select("sequence", "subscriber_id", "attempts")


LEASES = """(select consumer_group_id, stream_id, try_cast(regexp_extract(cursor_id, '^partition:64:([0-9]+)$', 1) as integer) as partition_id,
  'worker-' || (try_cast(regexp_extract(cursor_id, '^partition:64:([0-9]+)$', 1) as integer) * try_cast(regexp_extract(cursor_id, '^partition:64:([0-9]+)$', 1) as integer) % 3) as owner_id, count(*) as generation,
  timestamp '2031-03-16 00:00:00' + to_minutes((count(*) % 9 - 4)::integer) as lease_until,
  coalesce(max(case when octet_length(cursor_order) = 8 then (('0x' || hex(cursor_order))::uhugeint::hugeint - 9223372036854775808)::bigint end), 0) as checkpoint_sequence
  from offsets where regexp_full_match(cursor_id, 'partition:64:[0-9]+') group by all)""".replace("group by all", "group by consumer_group_id, stream_id, cursor_id")


def leases(spark: SparkSession, d: str) -> DataFrame:
    """A lease table made of the committed partition cursors: three workers, generations from the number of commits."""
    form = r"^partition:64:([0-9]+)$"
    number = F.regexp_extract("cursor_id", form, 1).cast("int")
    valid = F.when(F.octet_length("cursor_order") == 8, stores.position_of(F.col("cursor"), F.col("cursor_order")))
    by = table(spark, d, "offsets").where(F.col("cursor_id").rlike(form)).groupBy(*stores.SCOPE, number.alias("partition_id")).agg(F.count("*").alias("generation"), F.coalesce(F.max(valid), F.lit(0)).alias("checkpoint_sequence"))
    return by.withColumns({
        "owner_id": F.concat(F.lit("worker-"), (F.col("partition_id") * F.col("partition_id") % 3).cast("string")),
        "lease_until": F.expr("timestamp_ntz '2031-03-16 00:00:00' + make_dt_interval(0, 0, cast(generation % 9 - 4 as int), 0)"),
    })


@add("live_consumers", f"select consumer_group_id, stream_id, count(*) filter (until > timestamp '{AS_OF}') as n_live from (select consumer_group_id, stream_id, owner_id, max(lease_until) as until from {LEASES} group by all) group by all")
def live_consumers(spark: SparkSession, d: str) -> DataFrame:
    return stores.live(leases(spark, d).groupBy(*stores.SCOPE, "owner_id").agg(F.max("lease_until").alias("lease_until")), AS_OF)


@add("lease_claimable", f"select consumer_group_id, stream_id, partition_id, (owner_id is null or lease_until is null or lease_until < timestamp '{AS_OF}' or owner_id = 'worker-1') as claimable from {LEASES}")
def lease_claimable(spark: SparkSession, d: str) -> DataFrame:
    return leases(spark, d).select(*stores.SCOPE, "partition_id", stores.lease_open("worker-1", AS_OF).alias("claimable"))


OFFERS = f"(select consumer_group_id, stream_id, partition_id, owner_id, generation - (partition_id % 2) as generation, checkpoint_sequence + partition_id * 10 - 100 as position from {LEASES})"


def offers(spark: SparkSession, d: str) -> DataFrame:
    """Commits from the owners, half of them under an older generation."""
    return leases(spark, d).select(*stores.SCOPE, "partition_id", "owner_id", (F.col("generation") - F.col("partition_id") % 2).alias("generation"), (F.col("checkpoint_sequence") + F.col("partition_id") * 10 - 100).alias("position"))


@add("fenced_checkpoint", f"select o.consumer_group_id, o.stream_id, o.partition_id, case when o.owner_id = l.owner_id and o.generation = l.generation then greatest(o.position, l.checkpoint_sequence) else l.checkpoint_sequence end as checkpoint_after from {OFFERS} o join {LEASES} l using (consumer_group_id, stream_id, partition_id)")
def fenced_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return stores.fenced(leases(spark, d), offers(spark, d)).select(*stores.SCOPE, "partition_id", "checkpoint_after")


@add("stale_owner_rejects", f"select o.consumer_group_id, o.stream_id, o.partition_id, o.owner_id from {OFFERS} o join {LEASES} l using (consumer_group_id, stream_id, partition_id) where not (o.owner_id = l.owner_id and o.generation = l.generation)")
def stale_owner_rejects(spark: SparkSession, d: str) -> DataFrame:
    return stores.fenced(leases(spark, d), offers(spark, d)).where("not accepted").select(*stores.SCOPE, "partition_id", "owner_id")


@add("rebalance_target", f"select consumer_group_id, stream_id, least(ceil(count(*) / greatest(count(distinct owner_id), 1)) + 1, count(*))::bigint as target from {LEASES} group by all")
def rebalance_target(spark: SparkSession, d: str) -> DataFrame:
    shape = leases(spark, d).groupBy(*stores.SCOPE).agg(F.count("*").alias("total"), F.count_distinct("owner_id").alias("owners"))
    return shape.select(*stores.SCOPE, stores.target_count(F.col("total"), F.col("owners"), 1).alias("target"))


@add("rebalance_release", f"""with s as (select consumer_group_id, stream_id, least(ceil(count(*) / greatest(count(distinct owner_id), 1)), count(*)) as target from {LEASES} group by all),
r as (select *, row_number() over (partition by consumer_group_id, stream_id, owner_id order by partition_id desc) as high, count(*) over (partition by consumer_group_id, stream_id, owner_id) as owned from {LEASES})
select r.consumer_group_id, r.stream_id, r.owner_id, r.partition_id from r join s using (consumer_group_id, stream_id) where high <= owned - target""")
def rebalance_release(spark: SparkSession, d: str) -> DataFrame:
    return stores.releases(leases(spark, d))


@add("rebalance_claim", f"""with l as (select *, coalesce(owner_id = 'worker-1', false) and coalesce(lease_until >= timestamp '{AS_OF}', false) as held from {LEASES}),
s as (select consumer_group_id, stream_id, count(*) as total, count(*) filter (held) as owned from l group by all),
f as (select *, row_number() over (partition by consumer_group_id, stream_id order by partition_id) as n from l where not held and (owner_id is null or lease_until is null or lease_until < timestamp '{AS_OF}' or owner_id = 'worker-1'))
select f.consumer_group_id, f.stream_id, f.partition_id from f join s using (consumer_group_id, stream_id) where n <= least(ceil(total / 4.0), total) - owned""".replace("worker-1", "worker-9"))
def rebalance_claim(spark: SparkSession, d: str) -> DataFrame:
    """What a fourth worker that comes in takes of the leases that have run out."""
    return stores.next_claims(leases(spark, d), "worker-9", AS_OF, 4)


@add("coordinated_start", f"select consumer_group_id, stream_id, (case when count(*) filter (coalesce(checkpoint_sequence, 0) > 0) = count(*) then min(checkpoint_sequence) else 0 end)::bigint as start from {LEASES} group by all")
def coordinated_start(spark: SparkSession, d: str) -> DataFrame:
    return stores.shared_start(leases(spark, d))


@add("coordinated_resume", f"select l.consumer_group_id, l.stream_id, r.sequence from {LEASES} l join (select distinct sequence, partition_id from event_log) r on r.partition_id = l.partition_id where r.sequence > l.checkpoint_sequence and l.owner_id = 'worker-1'")
def coordinated_resume(spark: SparkSession, d: str) -> DataFrame:
    """Rows an owner still forwards of its partitions; the cursors are as few as there are partitions, so each row meets a handful."""
    mine = leases(spark, d).where("owner_id = 'worker-1'").select(*stores.SCOPE, F.col("partition_id").cast("bigint").alias("partition_id"), "checkpoint_sequence")
    return rows(spark, d, "partition_id").select("sequence", "partition_id").join(mine, "partition_id").where(F.col("sequence") > F.col("checkpoint_sequence")).select(*stores.SCOPE, "sequence")


# ---- settlement, commits and sinks ----


@add("settle_once", f"select event, arg_min(subscriber_id, (completed_at, subscriber_id)) as subscriber_id from (select {uuid_sql('event_id')} as event, subscriber_id, completed_at from multiplexer_completions) where event is not null group by event")
def settle_once(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "multiplexer_completions").select(F.lower(F.hex(uuid_key(F.col("event_id")))).alias("event"), "subscriber_id", "completed_at").where("event is not null")
    return stateful.settled_once(done, ["event"], "completed_at", "subscriber_id")


@add("commit_offsets", "select topic, partition_id, max(sequence) + 1 as next_offset from event_log where partition_id is not null group by all")
def commit_offsets(spark: SparkSession, d: str) -> DataFrame:
    return sinks.commit_offsets(table(spark, d, "event_log").where("partition_id is not null"), ["topic", "partition_id"])


@add("append_log", f"with old as (select * from {ROWS} where sequence <= {HISTORY}), new as (select * from (select *, row_number() over (partition by {uuid_sql('id')} order by sequence) as _n from {ROWS} where sequence > {LIVE}) where _n = 1) select id, topic, event_key, version, (select max(sequence) from old) + row_number() over (order by sequence) as sequence from new where {uuid_sql('id')} not in (select {uuid_sql('id')} from old)")
def append_log(spark: SparkSession, d: str) -> DataFrame:
    """New rows appended to an older state of the log: events it has are left out, the others are numbered on, whole."""
    log = rows(spark, d)
    new = log.where(F.col("sequence") > share(spark, d, 4)).withColumnRenamed("sequence", "arrival")
    return sinks.appended(log.where(F.col("sequence") <= share(spark, d, 6)), new, "arrival").select("id", "topic", "event_key", "version", "sequence")


@add("wire_encode", "select distinct sequence, id, organization, namespace, topic, event_key as key, content_type, case when content_type = 'application/json' then null else payload end as data, strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%fZ') as \"timestamp\", coalesce(metadata['producer'], '') as producer, len(map_keys(metadata)) as n_metadata, version, parent_id, correlation_id, causation_id from event_log")
def wire_encode(spark: SparkSession, d: str) -> DataFrame:
    """Wire texts, compared by the fields read back from them."""
    log = table(spark, d, "event_log").select("sequence", sinks.wire().alias("value"))
    event = sinks.unwire(log)
    e = "event."
    data = F.when(F.col("event.payload.content_type") != "application/json", F.col("event.payload.data")).alias("data")
    producer = F.coalesce(F.try_element_at("event.metadata", F.lit("producer")), F.lit("")).alias("producer")
    return event.select(
        "sequence", *(f"{e}{c}" for c in ("id", "organization", "namespace", "topic", "key", "timestamp", "version", "parent_id", "correlation_id", "causation_id")), f"{e}payload.content_type", data, producer,
        F.size("event.metadata").cast("bigint").alias("n_metadata"),
    ).distinct()


READABLE = "(json_valid(payload) and coalesce(json_type(case when json_valid(payload) then payload end) = 'OBJECT', false))"


@add("wire_decode_skip_poison", f"select sequence, topic, case when content_type = 'application/json' and {READABLE} then json_extract_string(payload, '$.currency') end as currency from event_log where content_type <> 'text/plain' and topic <> 'job.finished'")
def wire_decode_skip_poison(spark: SparkSession, d: str) -> DataFrame:
    """Wire bodies, of which those of plain texts are cut off in the middle and those of one topic have lost their key: these are acked and skipped."""
    log = table(spark, d, "event_log").withColumn("event_key", F.when(F.col("topic") != "job.finished", F.col("event_key")))
    body = F.when(F.col("content_type") == "text/plain", F.substring(sinks.wire(), 1, 60)).otherwise(sinks.wire())
    found = sinks.unwire(log.select("sequence", "topic", body.alias("value"))).where("readable")
    return found.select("sequence", "topic", F.when(E.is_object(F.col("event.payload.data")), F.try_variant_get(F.try_parse_json("event.payload.data"), "$.currency", "string")).alias("currency"))


@add("ack_batches", f"select organization, acked, sequence, tick, (row_number() over (partition by organization, acked, tick order by us, sequence) - 1) // 20 as batch from (select organization, {JSON} as acked, sequence, epoch_us(\"timestamp\") as us, epoch_us(\"timestamp\") // {HOUR} as tick from {ROWS})")
def ack_batches(spark: SparkSession, d: str) -> DataFrame:
    """Acks and nacks of each organization in buffers of 20 that are flushed every hour."""
    settles = rows(spark, d, "organization", "content_type", "timestamp").select("organization", (F.col("content_type") == "application/json").alias("acked"), "sequence", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"))
    return sinks.ack_batches(settles, ["organization", "acked"], "us", 20, HOUR).drop("us")


@add("concurrency_schedule", f"""with recursive r as (select organization, sequence, epoch_us("timestamp") as us, octet_length(encode(event_key)) * 60000000 as takes, row_number() over (partition by organization order by sequence) as rn from {ROWS}),
w as (select organization, sequence, rn, us as start_us, list_sort([us + takes, -9000000000000000, -9000000000000000, -9000000000000000]) as free from r where rn = 1
  union all
  select r.organization, r.sequence, r.rn, greatest(r.us, w.free[1]), list_sort(list_append(w.free[2:4], greatest(r.us, w.free[1]) + r.takes)) from w join r on r.organization = w.organization and r.rn = w.rn + 1)
select organization, sequence, start_us from w""")
def concurrency_schedule(spark: SparkSession, d: str) -> DataFrame:
    """When rows start whose handlers take a minute for each byte of the key, with four of an organization in flight."""
    values = {"us": F.unix_micros(F.col("timestamp").cast("timestamp")), "takes": (F.octet_length("event_key") * 60_000_000).cast("bigint")}
    return folds.fold(rows(spark, d, "organization", "event_key", "timestamp"), {"organization": F.col("organization")}, values, folds.permits(4), {"start_us": "bigint"})


@add("batch_writer_waits", f"""with recursive r as (select topic, sequence, octet_length(encode(event_key)) % 7 + 1 as n, epoch_us("timestamp") as us, row_number() over (partition by topic order by sequence) as rn from {ROWS}),
w as (
  select topic, sequence, rn, 0::bigint as flush, n as waiting, us as opened from r where rn = 1
  union all
  select r.topic, r.sequence, r.rn, w.flush + (w.waiting >= 100 or r.us > w.opened + {6 * HOUR})::integer, case when w.waiting >= 100 or r.us > w.opened + {6 * HOUR} then r.n else w.waiting + r.n end,
    case when w.waiting >= 100 or r.us > w.opened + {6 * HOUR} then r.us else w.opened end from w join r on r.topic = w.topic and r.rn = w.rn + 1)
select topic, sequence, flush from w""")
def batch_writer_waits(spark: SparkSession, d: str) -> DataFrame:
    """Flushes of at least 100 events per topic, or of what has come within 6 hours of the first."""
    values = {"n": (F.octet_length("event_key") % 7 + 1).cast("bigint"), "us": F.unix_micros(F.col("timestamp").cast("timestamp"))}
    return folds.fold(rows(spark, d, "topic", "event_key", "timestamp"), {"topic": F.col("topic")}, values, folds.grouped_requests(100, 6 * HOUR), {"flush": "bigint"})


@add("sqs_batches")
def sqs_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of at most 10 entries and 256 KiB per partition, by the size of the wire text."""
    log = table(spark, d, "event_log").dropDuplicates(["sequence"]).select("sequence", "partition_id", F.octet_length(sinks.wire()).cast("bigint").alias("size"))
    return folds.fold(log, {"partition_id": F.col("partition_id")}, {"size": F.col("size")}, folds.batches(10, 256 * 1024), {"batch": "bigint"})


@add("batch_writer_groups", f"""with recursive r as (select topic, sequence, octet_length(encode(event_key)) % 7 + 1 as n, row_number() over (partition by topic order by sequence) as rn from {ROWS}),
w as (
  select topic, sequence, rn, 0::bigint as flush, n as waiting from r where rn = 1
  union all
  select r.topic, r.sequence, r.rn, w.flush + (w.waiting >= 100)::integer, case when w.waiting >= 100 then r.n else w.waiting + r.n end from w join r on r.topic = w.topic and r.rn = w.rn + 1)
select topic, sequence, flush from w""")
def batch_writer_groups(spark: SparkSession, d: str) -> DataFrame:
    """Requests of 1 to 7 events gathered to flushes of at least 100, per topic."""
    return folds.fold(rows(spark, d, "topic", "event_key"), {"topic": F.col("topic")}, {"n": (F.octet_length("event_key") % 7 + 1).cast("bigint")}, folds.grouped_requests(100), {"flush": "bigint"})


# one step for each row served; a row enters as soon as fewer than 128 of its lane wait, and holds up those behind it until then
LANES = f"""with recursive k as (select organization, sequence, (partition_id % 8)::integer as lane, row_number() over (partition by organization order by sequence) as rn from {ROWS} where partition_id is not null),
q as (select organization, [{', '.join(f"coalesce(list(rn order by rn) filter (lane = {i}), []::bigint[])" for i in range(8))}] as lanes from k group by organization),
w as (select organization, 0::bigint as position, 0 as last, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[] as served, 0::bigint as rn from q
  union all
  select organization, position + 1, pick, list_transform(range(1, 9), lambda l: served[l] + (l = pick + 1)::bigint), lanes[pick + 1][served[pick + 1] + 1] from (
    select *, case when waiting[last + 1] > 0 then last else ((last + list_sort(list_transform(range(1, 9), lambda i: {{'d': -waiting[(last + i) % 8 + 1], 'i': i}}))[1].i) % 8)::integer end as pick from (
      select *, list_transform(range(1, 9), lambda l: len(list_filter(lanes[l], lambda x: x < blocked)) - served[l]) as waiting from (
        select w.*, q.lanes, list_min(list_transform(range(1, 9), lambda l: coalesce(q.lanes[l][w.served[l] + 129], 9000000000000000000))) as blocked from w join q on q.organization = w.organization)))
  where list_sum(waiting) > 0)
select organization, k.sequence, k.lane, w.position from w join k using (organization, rn)"""


@add("lane_depth_weighted", LANES)
def lane_depth_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Service of 8 lanes by depth, with room for 128 rows each, per organization."""
    lanes = rows(spark, d, "organization", "partition_id").where("partition_id is not null")
    made = folds.fold(lanes, {"organization": F.col("organization")}, {"lane": (F.col("partition_id") % 8).cast("int")}, folds.deepest_lane(8, 128), {"served": "bigint", "lane": "int", "position": "bigint"}, many=True)
    return made.select("organization", F.col("served").alias("sequence"), "lane", "position")


@add("writer_map", f"select sequence, topic || '.v' || version as topic from {ROWS}")
def writer_map(spark: SparkSession, d: str) -> DataFrame:
    return sinks.mapped(rows(spark, d, "topic", "version"), {"topic": F.concat("topic", F.lit(".v"), F.col("version").cast("string"))}, valid=F.col("version") > 0).select("sequence", "topic")


@add("writer_flat_map", f"select sequence, unnest(str_split(topic, '.')) as part from {ROWS} where version <> 2")
def writer_flat_map(spark: SparkSession, d: str) -> DataFrame:
    """None for version 2, else one event per part of the topic."""
    return sinks.flat_mapped(rows(spark, d, "topic", "version"), F.when(F.col("version") != 2, F.split("topic", r"\.")), "part").select("sequence", "part")


@add("writer_filter", f"select sequence, topic from {ROWS} where topic = 'job.finished'")
def writer_filter(spark: SparkSession, d: str) -> DataFrame:
    return sinks.filtered(rows(spark, d), EventFilter(topic="job.finished")).select("sequence", "topic")


@add("writer_fanout", f"select writer, count(*) as n, max(sequence) as last from {ROWS}, (select unnest(['audit', 'search']) as writer) group by writer")
def writer_fanout(spark: SparkSession, d: str) -> DataFrame:
    return sinks.fanned_out(rows(spark, d), ["audit", "search"]).groupBy("writer").agg(F.count("*").alias("n"), F.max("sequence").alias("last"))
