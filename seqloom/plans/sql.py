"""SQL of the problems 1 to 6: plain statements of the results, for comparison only."""

from __future__ import annotations


def uuid_sql(text: str) -> str:
    """The 32 lower-case digits of a UUID in any spelling; null for other text."""
    bare = f"lower(regexp_replace({text}, '^\\s+|\\s+$', '', 'g'))"
    return f"(case when regexp_full_match({bare}, '(?:urn:uuid:)?\\{{?[0-9a-f]{{8}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{12}}\\}}?') then regexp_replace(regexp_replace({bare}, '^urn:uuid:', ''), '[{{}}-]', '', 'g') end)"


def hyphened(digits: str) -> str:
    return f"substr({digits}, 1, 8) || '-' || substr({digits}, 9, 4) || '-' || substr({digits}, 13, 4) || '-' || substr({digits}, 17, 4) || '-' || substr({digits}, 21, 12)"


FIRST = f"""f as (select * from (
  select *, {uuid_sql('id')} as event, row_number() over (partition by {uuid_sql('id')} order by sequence) as _n
  from (select distinct sequence, id, organization, "timestamp", payload, event_key, parent_id, causation_id, partition_id from event_log)) where _n = 1 and event is not null)"""

CLASSES = f"""{FIRST},
s as (select regexp_extract(key, '^([a-z0-9_-]+)@', 1) as organization, regexp_extract(key, '@([0-9]+)$', 1)::bigint as sequence, arg_max(ts, (updated_at, ts)) as ts
  from watermarks where regexp_full_match(key, '[a-z0-9_-]+@[0-9]{{1,18}}') group by key),
u as (select organization, sequence, 0 as k, "timestamp" as t, date_trunc('hour', "timestamp") as period, octet_length(encode(payload)) as size, event_key, null::timestamp as ts from f
  union all select organization, sequence, 1, null, null, null, null, ts from s),
w as (select *, max(ts) over q as cut, max(period) over q as seen from u window q as (partition by organization order by sequence, k rows between unbounded preceding and 1 preceding)),
c as (select organization, sequence, period::timestamp as period, size, event_key, case when t <= cut then 'dropped' when seen > period then 'corrected' else 'on_time' end as outcome from w where k = 0)"""

P1_FOUND = f"with {CLASSES} select sequence, outcome from c where outcome <> 'on_time'"

P1_PERIOD_COUNTS = f"""with {CLASSES} select organization, period, count(*) filter (outcome = 'on_time') as n_on_time, count(*) filter (outcome = 'corrected') as n_corrected, count(*) filter (outcome = 'dropped') as n_dropped,
  count(*) filter (outcome <> 'dropped') as n_events, count(distinct event_key) filter (outcome <> 'dropped') as n_keys, count(distinct size) filter (outcome <> 'dropped') as n_sizes,
  min(size) filter (outcome <> 'dropped') as min_size, max(size) filter (outcome <> 'dropped') as max_size, median(size) filter (outcome <> 'dropped') as median_size from c group by all"""

_FIELDS = ("event_key", "partition_key", "partition_id")
P2_KEY_TOTALS = " union all ".join(f"select '{f}' as field, {f}::varchar as val, {f} is null as is_null, count(*) as n, max(sequence) as last_sequence, min(\"timestamp\") as first_ts, max(\"timestamp\") as last_ts from event_log group by {f}" for f in _FIELDS)
P2_FOUND = f"select field, val from ({P2_KEY_TOTALS}) where not is_null and n * 100 >= 3 * (select count(*) from event_log)"

ORPHANS = f"""{FIRST},
r as (select 'event_log.parent_id' as src, {uuid_sql('parent_id')} as ref, sequence::varchar as row_key, sequence as seq, "timestamp"::date as day from f
  union all select 'event_log.causation_id', {uuid_sql('causation_id')}, sequence::varchar, sequence, "timestamp"::date from f
  union all select 'multiplexer_completions.event_id', {uuid_sql('event_id')}, subscriber_id, null, min(completed_at)::date from multiplexer_completions where subscriber_id is not null group by 2, 3),
o as (select r.src, {hyphened('r.ref')} as ref_id, r.row_key, r.day, case when f.event is not null then 'late' when r.ref in (select {uuid_sql('event_id')} from dedupe where {uuid_sql('event_id')} is not null) then 'deleted' else 'missing' end as kind
  from r left join f on f.event = r.ref where r.ref is not null and (f.event is null or f.sequence > r.seq))"""
P3_FOUND = f"with {ORPHANS} select src, ref_id, row_key, kind from o"
P3_COUNTS = f"with {ORPHANS} select src, day::varchar as day, kind, count(*) as n_refs, count(distinct ref_id) as n_ids from o group by all"

P4_FOUND = f"""with {FIRST},
m as (select consumer_group_id, stream_id, cursor_id, case when octet_length(cursor_order) = 8 then (('0x' || hex(cursor_order))::uhugeint::hugeint - 9223372036854775808)::bigint
  else try_cast(trim(json_extract_string(case when json_valid("cursor") then "cursor" end, '$.sequence')) as bigint) end as pos from offsets where cursor_id = 'global' or regexp_full_match(cursor_id, 'partition:64:[0-9]+')),
p as (select consumer_group_id, stream_id, case when cursor_id = 'global' then null else split_part(cursor_id, ':', 3)::bigint end as part, coalesce(max(pos), 0) as pos from m group by all),
g as (select distinct consumer_group_id, stream_id from p where part is not null)
select consumer_group_id, stream_id, sequence from p join f on sequence > pos where part is null
union select g.consumer_group_id, g.stream_id, f.sequence from g join f on f.partition_id between 0 and 63 left join p on p.consumer_group_id = g.consumer_group_id and p.stream_id = g.stream_id and p.part = f.partition_id where f.sequence > coalesce(p.pos, 0)"""

STORED = "r as (select distinct sequence, topic from event_log), e as (select max(sequence) as top from event_log)"
P4_CHANGES = f"""with {STORED} select sequence, 'added' as change from r, e where sequence > top * 4 // 5
union all select sequence, 'changed' from r, e where topic = 'cart.updated' and sequence > top // 2 and sequence <= top * 4 // 5 union all select -1 - event_id, 'deleted' from events"""
P4_RERUNS = f"with {STORED} select sequence, topic, case when sequence <= top // 2 then 1 else 3 end::integer as run from r, e"

TREE = f"""recursive {FIRST},
l as (select sequence as node, case when trim(coalesce(parent_id, ''), ' \t\n\r') <> '' then {uuid_sql('parent_id')} else {uuid_sql('causation_id')} end as up from f),
n as (select l.node, f.sequence as parent from l left join f on f.event = l.up),
t as (select node, node as root, 0 as depth, [node] as path from n where parent is null union all select n.node, t.root, t.depth + 1, list_append(t.path, n.node) from t join n on n.parent = t.node),
u as (select node, parent from n where node not in (select node from t)),
k as (select count(*) as many from u),
walk as (select node, parent as spot, 1::bigint as steps from u union all select walk.node, u.parent, steps + 1 from walk join u on u.node = walk.spot cross join k where steps < 2 * many),
low as (select walk.node, min(spot) as low from walk, k where steps > many group by walk.node)"""
P6_FOUND = f"with {TREE} select node as sequence, root as root_sequence, depth from t where depth > 0 union all select node, low, -1 from low"
P6_PATHS = f"""with {TREE}, below as (select unnest(path[1:depth]) as node, count(*) as n from t where depth > 0 group by 1)
select t.node as sequence, root as root_sequence, depth, array_to_string(path, '/') as path, coalesce(n, 0) as n_descendants from t left join below on below.node = t.node union all select node, low, -1, null, null from low"""
P6_DESCENDANTS = f"with {TREE} select path[i] as sequence, node as descendant_sequence, (depth + 1 - i)::integer as distance from (select node, depth, path, unnest(range(1, depth + 1)) as i from t)"
P6_CYCLES = f"with {TREE} select node as sequence, low as cycle_sequence, node in (select spot from walk, k where steps > many) as on_cycle from low"
