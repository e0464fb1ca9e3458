"""DuckDB SQL for the registered queries, written against the same source tables.

The SQL is derived on its own: payload fields by JSON path, canonical texts by
concatenation, shapes by ``json_tree``, detector states by counting over ranks.
"""

from __future__ import annotations

from .fixture import duckdb_recipe


def _uuid(seed: str) -> str:
    h = f"sha256({seed})"
    return (
        f"substr({h},1,8) || '-' || substr({h},9,4) || '-4' || substr({h},14,3) || '-' || "
        f"substr('89ab', (strpos('0123456789abcdef', substr({h},17,1)) - 1) % 4 + 1, 1) || substr({h},18,3) "
        f"|| '-' || substr({h},21,12)"
    )


_FIELDS = [
    ("model", "model"),
    ("usage.input_tokens", "input_tokens"),
    ("usage.output_tokens", "output_tokens"),
    ("cost.amount_usd", "cost"),
    ("actor.raw_user_id", "raw_user_id"),
]
_EXPECTS = ",".join(name for name, _ in _FIELDS)

ARR = f"a as materialized ({duckdb_recipe()})"

# The arrivals once more, by building JSON values instead of texts.
ARRIVALS = """
with priced as (
  select *, ['cursor', 'openai', 'anthropic'][(event_id + 1) % 3 + 1] who, timestamp '2024-01-28 12:00:00' moved,
    -- six decimals, as text: amounts keep their zeros
    format('0.{:06d}', 1000 + cast(round("value" * 100) as bigint)) usd from events
), deliveries as (
  select *, unnest(list_filter([
    {'after': 0, 'due': true}, {'after': 5, 'due': event_id % 31 = 0},
    {'after': 7, 'due': event_id % 47 = 0 and event_id % 3 = 0 and ts < moved}], lambda d: d.due)) d from priced
), bodies as (
  select event_id * 10 + d.after seq, ts received_at, who, usd,
    to_json({'id': 'oa_' || event_id, 'object': if(event_id % 5 = 0, 'text.completion', 'chat.completion'),
      'created': epoch_us(ts) // 1000000, 'model': if(event_id % 997 = 0, to_json(404), to_json('gpt-' || event_id % 2)),
      'user': 'u_' || user_id,
      'usage': {'prompt_tokens': 40 + 5 * user_id, 'completion_tokens': 12 + cast(floor("value") as bigint)}}) openai,
    case when ts >= moved then to_json({'pricing': {'cost': {'amount_usd': usd}}})
      when event_id % 47 = 0 and d.after < 7 then to_json({'cost': {'amount_usd': null}})
      else to_json({'cost': {'amount_usd': usd}}) end paid,
    to_json({'id': 'an_' || event_id, 'type': 'message', 'model': 'claude-' || event_id % 2,
      'created_at': strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'),
      'usage': {'input_tokens': 40 + 5 * user_id, 'output_tokens': 12 + cast(floor("value") as bigint)},
      'metadata': {'user_id': 'u_' || user_id}, 'cost_usd': usd}) anthropic,
    to_json({'request_id': 'cu_' || event_id, 'kind': 'edit', 'model': 'cursor-' || event_id % 2,
      'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'),
      'tokens': {'in': 40 + 5 * user_id, 'out': 12 + cast(floor("value") as bigint)},
      'user': {'id': 'u_' || user_id}, 'billing': {'usd': usd}}) cursor
  from deliveries
)
select seq, received_at, provider, replace(quoted, chr(34) || usd || chr(34), usd) payload from (select seq, received_at, who provider, case who
  when 'openai' then left(openai::varchar, -1) || ',' || substr(paid::varchar, 2)
  when 'anthropic' then anthropic::varchar else cursor::varchar end as quoted, usd
from bodies)
"""

NORM = """
n0 as (select seq, received_at, provider, payload,
  case provider when 'cursor' then payload->>'$.request_id' else payload->>'$.id' end pid,
  case provider
    when 'openai' then strftime(make_timestamp(cast(payload->>'$.created' as bigint)*1000000), '%Y-%m-%dT%H:%M:%S.%gZ')
    when 'anthropic' then payload->>'$.created_at' else payload->>'$.timestamp' end occurred_at_text,
  case provider when 'cursor' then 'edit' when 'anthropic' then 'chat'
    else case when payload->>'$.object' = 'text.completion' then 'completion' else 'chat' end end event_type,
  case when json_type(payload, '$.model') = 'VARCHAR' then payload->>'$.model' end model,
  case when json_type(payload, '$.model') = 'VARCHAR' then '' else 'model:not_string' end reasons,
  case provider when 'openai' then payload->>'$.user' when 'anthropic' then payload->>'$.metadata.user_id'
    else payload->>'$.user.id' end raw_user_id,
  cast(case provider when 'openai' then payload->>'$.usage.prompt_tokens'
    when 'anthropic' then payload->>'$.usage.input_tokens' else payload->>'$.tokens.in' end as integer) input_tokens,
  cast(case provider when 'openai' then payload->>'$.usage.completion_tokens'
    when 'anthropic' then payload->>'$.usage.output_tokens' else payload->>'$.tokens.out' end as integer) output_tokens,
  cast(case provider when 'openai' then payload->>'$.cost.amount_usd'
    when 'anthropic' then payload->>'$.cost_usd' else payload->>'$.billing.usd' end as decimal(38,18)) cost,
  cast(payload->>'$.pricing.cost.amount_usd' as decimal(38,18)) moved_cost,
  case provider
    when 'openai' then
      case when json_exists(payload, '$.cost')
        then '{"cost":{"amount_usd":' || cast(json_extract(payload, '$.cost.amount_usd') as varchar) || '},' else '{' end
      || '"created":' || cast(json_extract(payload, '$.created') as varchar)
      || ',"id":' || cast(json_extract(payload, '$.id') as varchar)
      || ',"model":' || cast(json_extract(payload, '$.model') as varchar)
      || ',"object":' || cast(json_extract(payload, '$.object') as varchar)
      || case when json_exists(payload, '$.pricing')
        then ',"pricing":{"cost":{"amount_usd":' || cast(json_extract(payload, '$.pricing.cost.amount_usd') as varchar) || '}}'
        else '' end
      || ',"usage":{"completion_tokens":' || cast(json_extract(payload, '$.usage.completion_tokens') as varchar)
      || ',"prompt_tokens":' || cast(json_extract(payload, '$.usage.prompt_tokens') as varchar)
      || '},"user":' || cast(json_extract(payload, '$.user') as varchar) || '}'
    when 'anthropic' then
      '{"cost_usd":' || cast(json_extract(payload, '$.cost_usd') as varchar)
      || ',"created_at":' || cast(json_extract(payload, '$.created_at') as varchar)
      || ',"id":' || cast(json_extract(payload, '$.id') as varchar)
      || ',"metadata":{"user_id":' || cast(json_extract(payload, '$.metadata.user_id') as varchar)
      || '},"model":' || cast(json_extract(payload, '$.model') as varchar)
      || ',"type":' || cast(json_extract(payload, '$.type') as varchar)
      || ',"usage":{"input_tokens":' || cast(json_extract(payload, '$.usage.input_tokens') as varchar)
      || ',"output_tokens":' || cast(json_extract(payload, '$.usage.output_tokens') as varchar) || '}}'
    else
      '{"billing":{"usd":' || cast(json_extract(payload, '$.billing.usd') as varchar)
      || '},"kind":' || cast(json_extract(payload, '$.kind') as varchar)
      || ',"model":' || cast(json_extract(payload, '$.model') as varchar)
      || ',"request_id":' || cast(json_extract(payload, '$.request_id') as varchar)
      || ',"timestamp":' || cast(json_extract(payload, '$.timestamp') as varchar)
      || ',"tokens":{"in":' || cast(json_extract(payload, '$.tokens.in') as varchar)
      || ',"out":' || cast(json_extract(payload, '$.tokens.out') as varchar)
      || '},"user":{"id":' || cast(json_extract(payload, '$.user.id') as varchar) || '}}'
  end canonical_json
  from a),
n as materialized (select *, sha256(provider || '|' || pid) dedup_key, sha256(canonical_json) content_hash,
  cast(substr(occurred_at_text, 1, 23) as timestamp) occurred_at from n0),
acc as materialized (select * from n where reasons = '')
"""

CORPUS = """
corpus as materialized (select * from (
  select *, row_number() over (partition by content_hash order by seq) rn from acc) where rn = 1)
"""

SHAPES = r"""
docs as (select distinct content_hash, payload from n),
leaves as materialized (select distinct d.content_hash,
    regexp_replace(replace(t.fullkey, '$.', ''), '\[[0-9]+\]', '[]', 'g') path
  from docs d, json_tree(d.payload) t where t.type not in ('OBJECT', 'ARRAY')),
shape as materialized (select content_hash, string_agg(path, chr(10) order by path) fingerprint,
    string_agg(path, ',' order by path) paths, count(*) n_paths from leaves group by content_hash)
"""

KNOWN = """
known as materialized (select c.provider, s.fingerprint, min(c.seq) first_seq, count(*) n
  from corpus c join shape s using (content_hash) group by all),
usual as materialized (select provider, fingerprint, n from (
  select *, row_number() over (partition by provider order by n desc, fingerprint) rn from known) where rn = 1)
"""

EVENTS = f"""
steps as (select *,
    last_value(cost ignore nulls) over w cost_now, last_value(input_tokens ignore nulls) over w in_now,
    last_value(output_tokens ignore nulls) over w out_now, row_number() over (partition by dedup_key order by seq) k
  from acc window w as (partition by dedup_key order by seq rows unbounded preceding)),
changes as (select *,
    case when k > 1 and (cost_now is distinct from lag(cost_now) over v or in_now is distinct from lag(in_now) over v
      or out_now is distinct from lag(out_now) over v) then 1 else 0 end changed
  from steps window v as (partition by dedup_key order by seq)),
results as materialized (select *, k = 1 inserted,
    cast(1 + sum(changed) over (partition by dedup_key order by seq rows unbounded preceding) as integer) revision
  from changes),
ev as materialized (select dedup_key, {_uuid('dedup_key')} event_id, provider, 1 parser_version,
    arg_max(content_hash, seq) content_hash,
    arg_min(occurred_at_text, seq) occurred_at_text, arg_min(occurred_at, seq) occurred_at,
    arg_min(event_type, seq) event_type, arg_min(model, seq) model, arg_min(raw_user_id, seq) raw_user_id,
    arg_max(in_now, seq) input_tokens, arg_max(out_now, seq) output_tokens,
    max_by(cost, seq) filter (where cost is not null) as cost,
    max(revision) revision, arg_min(received_at, seq) ingested_at, min(seq) first_seq,
    min(seq) filter (where cost is not null) cost_seq
  from results group by dedup_key, provider)
"""

_STAT_ROWS = " union all ".join(
    f"""select provider, '{name}' field, {i} pos, count(*) filter (where rn > 20) overall_seen,
      count({column}) filter (where rn > 20) overall_populated, count(*) filter (where rn <= 20) recent_seen,
      count({column}) filter (where rn <= 20) recent_populated from ranked group by provider"""
    for i, (name, column) in enumerate(_FIELDS)
)
STATS = f"""
ranked as materialized (select *, row_number() over (partition by provider order by first_seq desc) rn from ev),
stats as materialized ({_STAT_ROWS})
"""

# Detector state after every arrival that changes it, by counting over event ranks.
_AT = {"model": "first_seq", "input_tokens": "first_seq", "output_tokens": "first_seq", "cost": "cost_seq",
       "raw_user_id": "first_seq"}
FIRE = f"""
e as (select provider, row_number() over (partition by provider order by first_seq) rk, first_seq s,
    {', '.join(f'{_AT[c]} q{i}' for i, (_, c) in enumerate(_FIELDS))} from ev),
lf as materialized ({' union all '.join(f"select provider, '{n}' field, rk, s, q{i} q from e" for i, (n, _) in enumerate(_FIELDS))}),
points as (select provider, field, s t from lf union select provider, field, q from lf where q is not null),
moves as (select provider, field, t, 0 seen, 0 pop from points
  union all select provider, field, s, 1, 0 from lf
  union all select provider, field, q, 0, 1 from lf where q is not null),
sums as (select provider, field, t, sum(seen) seen, sum(pop) pop from moves group by all),
totals as materialized (select provider, field, t,
    cast(sum(seen) over w as bigint) seen, cast(sum(pop) over w as bigint) pop
  from sums window w as (partition by provider, field order by t rows unbounded preceding)),
recent as (select x.provider, x.field, x.t, any_value(x.seen) seen, any_value(x.pop) pop,
    count(*) filter (where lf.q <= x.t) rec
  from totals x join lf on lf.provider = x.provider and lf.field = x.field
    and lf.rk > x.seen - 20 and lf.rk <= x.seen
  group by x.provider, x.field, x.t),
state as (select provider, field, t, seen - least(seen, 20) overall_seen, pop - rec overall_populated,
    least(seen, 20) recent_seen, rec recent_populated from recent),
fired as materialized (select * from (
  select *, row_number() over (partition by provider, field order by t) rn from state
  where overall_seen >= 30 and recent_seen >= 10 and overall_populated / overall_seen >= 0.9
    and recent_populated / recent_seen <= 0.1) where rn = 1)
"""

_DARK_MESSAGE = (
    "printf('%s went dark: %.0f%% populated historically, %.0f%% across the last %d. Parser never threw.', "
    "field, 100.0 * overall_populated / overall_seen, 100.0 * recent_populated / recent_seen, recent_seen)"
)

STRUCTURAL = """
opened as (select provider, min(seq) opened_seq from corpus group by provider),
judged as (select n.provider, s.fingerprint, min(n.seq) seq from acc n join shape s using (content_hash)
  join opened o using (provider) where n.seq > o.opened_seq group by all),
struct_alerts as materialized (
  select j.seq, j.provider, j.fingerprint,
    list_sort(list_filter(string_split(j.fingerprint, chr(10)), lambda p: not list_contains(k.paths, p))) added,
    list_sort(list_filter(k.paths, lambda p: not list_contains(string_split(j.fingerprint, chr(10)), p))) removed
  from judged j
  join opened o on o.provider = j.provider
  left join known c on c.provider = j.provider and c.fingerprint = j.fingerprint
  join lateral (select list_distinct(flatten(list(string_split(x.fingerprint, chr(10))))) paths
    from known x where x.provider = j.provider and x.first_seq < j.seq) k on true
  where c.first_seq is null or c.first_seq > o.opened_seq)
"""

ALERTS = f"""
both_alerts as (
  select seq, provider, 'STRUCTURAL' as type, 'warn' severity, null::varchar field,
    printf('New raw shape for %s: %d path(s) added, %d removed.', provider, len(added), len(removed)) message,
    fingerprint, array_to_string(added, ',') added, array_to_string(removed, ',') removed,
    null::double overall_rate, null::double recent_rate, null::bigint overall_seen, null::bigint recent_seen, 0 pos
  from struct_alerts
  union all
  select t, provider, 'SILENT_NULL', case when field = 'cost.amount_usd' then 'critical' else 'warn' end, field,
    {_DARK_MESSAGE}, null, null, null, overall_populated / overall_seen, recent_populated / recent_seen,
    overall_seen, recent_seen,
    list_position([{', '.join(repr(n) for n, _ in _FIELDS)}], field) from fired),
al as materialized (select row_number() over (order by b.seq, b.type desc, b.pos, b.fingerprint) id, b.*,
    a.received_at created_at from both_alerts b join a using (seq))
"""

_EVENT_SELECT = f"""event_id, dedup_key, provider, parser_version, {_uuid('content_hash')} raw_payload_id, occurred_at,
  event_type, model, raw_user_id, input_tokens, output_tokens, cast(cost as double) cost_amount_usd, revision, ingested_at"""

# Openai payloads replayed under versions 1 to 3; the others under version 1.
REPLAY = """
replayed as materialized (
  select c.seq, c.provider, v.version, c.cost golden_cost,
    case when v.version = 1 then c.cost else coalesce(c.moved_cost, c.cost) end new_cost
  from corpus c join (values ('openai', 1), ('openai', 2), ('openai', 3), ('anthropic', 1), ('cursor', 1))
    v(provider, version) using (provider)),
outcomes as materialized (select *, case when version = 3 and new_cost is null then 'throw'
    when new_cost is not distinct from golden_cost then 'ok' else 'drift' end outcome from replayed),
cells as materialized (select v.provider, v.version, count(o.seq) total,
    count(o.seq) filter (where outcome = 'ok') ok, count(o.seq) filter (where outcome = 'drift') drift,
    count(o.seq) filter (where outcome = 'throw') throw
  from (values ('openai', 1), ('openai', 2), ('openai', 3), ('anthropic', 1), ('cursor', 1)) v(provider, version)
  left join outcomes o using (provider, version) group by all)
"""
_CELL_STATUS = "case when throw > 0 then 'red' when drift > 0 then 'amber' else 'green' end"

_SERIES = " union all ".join(
    f"""select provider, '{name}' field, string_agg(case when {column} is null then '0' else '1' end, '' order by rn desc) series,
      avg(case when {column} is null then 0 else 1 end) filter (where rn <= 20) rate
      from ranked where rn <= 40 group by provider"""
    for name, column in _FIELDS
)
SERIES = f"series as materialized ({_SERIES})"
_VITAL = """select provider, replace(replace(field, 'usage.', ''), 'cost.amount', 'cost.amount') field, series, rate,
  case when rate >= 0.9 then 'alive' when rate <= 0.1 then 'dark' else 'warn' end state
  from series where field != 'actor.raw_user_id'"""

# Per event: missing fields, shape difference, silent-null analysis, replay verdict.
_MISSING = ", ".join(f"case when {column} is null then '{name}' end" for name, column in _FIELDS)
_PRESENT = ", ".join(f"case when {column} is not null then '{name}' end" for name, column in _FIELDS)
DESCRIBED = f"""
matched as (select *, list_filter([{_MISSING}], lambda x: x is not null) missing,
    list_filter([{_PRESENT}], lambda x: x is not null) populated from ev),
shaped as (select m.*, s.fingerprint, string_split(s.fingerprint, chr(10)) cur, string_split(u.fingerprint, chr(10)) base
  from matched m join shape s using (content_hash) join usual u on u.provider = m.provider),
diffed as (select *, list_sort(list_filter(cur, lambda p: not list_contains(base, p))) added,
    list_sort(list_filter(base, lambda p: not list_contains(cur, p))) removed from shaped),
hist as (select s.provider, s.field, coalesce(overall_populated / nullif(overall_seen, 0), 1.0) historical,
    coalesce(recent_populated / nullif(recent_seen, 0), 1.0) recent, series.series
  from stats s join series using (provider, field)),
described as materialized (select d.*, len(added) > 0 or len(removed) > 0 changed,
    h.field dark_field, h.historical historical_rate, h.recent recent_rate, h.series,
    case when h.field is null then null when h.field = 'cost.amount_usd' then 'CRITICAL' else 'WARN' end silent,
    r.historical_payloads, m.missing_cost, c.received_at
  from diffed d
  left join hist h on h.provider = d.provider and h.field = d.missing[1]
    and h.historical >= 0.9 and h.recent <= 1 - 0.9 + 0.0001
  join (select provider, count(*) historical_payloads from corpus group by provider) r on r.provider = d.provider
  join (select provider, count(*) filter (where cost is null) missing_cost from ev group by provider) m on m.provider = d.provider
  join corpus c on c.content_hash = d.content_hash),
fixes as materialized (select d.event_id, 2 suggested_version from described d join corpus c using (content_hash)
  where d.provider = 'openai' and list_contains(d.missing, 'cost.amount_usd') and c.moved_cost is not null)
"""
_STATUS = """case when silent = 'CRITICAL' then 'Silent Null' when changed or silent is not null then 'Drift'
  else 'Healthy' end"""
_CAUSE = """case when changed then 'Provider moved a field: ' ||
    case when len(removed) > 0 then array_to_string(removed, ', ') else '—' end || ' → ' ||
    case when len(added) > 0 then array_to_string(added, ', ') else '—' end || '.'
  when silent is not null then dark_field || ' stopped populating without a parse error.'
  else 'No incident — every expected field is populating normally.' end"""
_IMPACT = """case when len(missing) > 0 then missing_cost || ' ' || d.provider || ' events currently missing '
  || array_to_string(missing, ', ') || '.' else 'No fields missing on this event.' end"""
_FIX = """case when f.suggested_version is not null
  then 'Upgrade to ' || d.provider || ' parser v' || f.suggested_version || ' (reads the moved field).'
  else 'On the latest parser — no upgrade needed.' end"""
RELATED = """
related as materialized (select d.event_id,
    coalesce(string_agg(cast(al.id as varchar), ',' order by al.id desc), '') alert_ids
  from described d left join al on al.provider = d.provider and (
    (al.type = 'SILENT_NULL' and list_contains(d.missing, al.field)) or (al.type = 'STRUCTURAL' and d.changed))
  group by d.event_id)
"""
TARGETS = """
focus as materialized (select provider, coalesce(max_by(event_id, first_seq) filter (where cost is null),
    max_by(event_id, first_seq)) event_id from ev group by provider),
targets as materialized (select al.id, al.provider, al.type, al.field, coalesce(
    (select max_by(d.event_id, d.first_seq) from described d where d.provider = al.provider and al.type = 'SILENT_NULL'
      and list_contains(d.missing, al.field)),
    (select max_by(d.event_id, d.first_seq) from described d where d.provider = al.provider
      and al.type = 'STRUCTURAL' and d.fingerprint = al.fingerprint),
    (select f.event_id from focus f where f.provider = al.provider)) event_id from al)
"""


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


_BASE = (ARR, NORM)
_FOLDED = (*_BASE, EVENTS)
_STORED = (*_BASE, CORPUS)
_SHAPED = (*_STORED, SHAPES, KNOWN)
_RANKED = (*_FOLDED, STATS)
_ALERTED = (*_SHAPED, EVENTS, STRUCTURAL, FIRE, ALERTS)
_DESCRIBED = (*_SHAPED, EVENTS, STATS, SERIES, DESCRIBED)
_INSPECTED = (*_ALERTED, STATS, SERIES, DESCRIBED, RELATED, TARGETS)
_REPLAYED = (*_STORED, REPLAY)


def _normalized(provider: str | None, cost: str = "cost", version: str = "1") -> str:
    where = f"where provider = '{provider}'" if provider else ""
    return _with(*_BASE) + f"""select seq, provider, {version} parser_version, dedup_key, occurred_at_text, occurred_at,
      event_type, model, raw_user_id, cast(input_tokens as double) input_tokens,
      cast(output_tokens as double) output_tokens, cast({cost} as double) cost_value, reasons parse_reasons
      from n {where}"""


_PINNED = """pinned as (select seq, provider, case when seq % 10 = 5 then 1 when seq % 10 = 7 then 9 else 0 end as version
  from a),
route as materialized (select *, case when version = 9 then null when version = 1 then 1
  when provider = 'openai' then 2 else 1 end parser_version from pinned)"""

_STAGES = """select event_id, unnest([
  {'stage': 'Payload Received', 'status': 'ok', 'detail': 'Raw JSON accepted', 'at': received_at},
  {'stage': 'Provider Identified', 'status': 'ok', 'detail': provider, 'at': received_at},
  {'stage': 'Parser Selected', 'status': 'ok', 'detail': provider || ' v' || parser_version, 'at': received_at},
  {'stage': 'Canonical Event Created', 'status': case when len(missing) > 0 then 'warn' else 'ok' end,
   'detail': case when len(missing) > 0 then array_to_string(missing, ', ') || ' read null'
     else 'All expected fields populated' end, 'at': occurred_at},
  {'stage': 'Deduplicated', 'status': 'ok', 'detail': case when revision > 1
     then 'merged backfill → revision ' || revision else 'new dedup_key' end, 'at': ingested_at},
  {'stage': 'Drift Detection', 'status': case when silent = 'CRITICAL' then 'fail'
     when changed or silent is not null then 'warn' else 'ok' end,
   'detail': case when silent = 'CRITICAL' then 'SILENT_NULL critical raised'
     when changed then 'structural shape change' else 'no drift' end, 'at': ingested_at},
  {'stage': 'Stored', 'status': 'ok', 'detail': 'event ' || left(event_id, 8) || '…', 'at': ingested_at},
  {'stage': 'Dashboard Updated', 'status': 'ok', 'detail': 'metrics + alerts refreshed', 'at': ingested_at}]) s
  from described"""


ORACLE: dict[str, str] = {
    "arrivals": ARRIVALS,
    "quarantine": _with(*_BASE) + "select seq, provider, reasons reason from n where reasons != ''",
    "corpus": _with(*_STORED, SHAPES) + f"""select {_uuid('content_hash')} raw_payload_id, content_hash, provider, seq,
      1 parser_version, fingerprint, dedup_key, event_type, model, input_tokens, output_tokens,
      cast(cost as double) cost_value from corpus join shape using (content_hash)""",
    "events": _with(*_FOLDED) + f"select {_EVENT_SELECT} from ev",
    "merged_events": _with(*_FOLDED) + f"select {_EVENT_SELECT} from ev",
    "alerts": _with(*_ALERTED) + """select id, seq, provider, type, severity, field, message, fingerprint, added, removed,
      overall_rate, recent_rate, overall_seen, recent_seen, created_at from al""",
    "canonical_json": _with(*_BASE) + "select seq, canonical_json from n",
    "content_hash": _with(*_BASE) + "select seq, content_hash from n",
    "dedup_key": _with(*_BASE) + "select seq, provider, dedup_key from n",
    "event_uuid": _with(*_BASE)
    + f"select seq, {_uuid('dedup_key')} event_id, {_uuid('content_hash')} raw_payload_id from n",
    "content_dedup": """select sha256(text) content_hash, min(doc_id) doc_id, count(*) copies, arg_min(lang, doc_id) lang,
      arg_min(source, doc_id) source, arg_min(n_chars, doc_id) n_chars from documents group by text""",
    "conversation_dedup": """select content_hash, conv_id, turn, copies, role from (select sha256(text) content_hash, conv_id, turn, role,
      count(*) over (partition by text) copies, row_number() over (partition by text order by conv_id, turn) rn
      from conversations) where rn = 1""",
    "normalize_openai_v1": _normalized("openai"),
    "normalize_openai_v2": _normalized("openai", "coalesce(moved_cost, cost)", "2"),
    "normalize_anthropic_v1": _normalized("anthropic"),
    "normalize_cursor_v1": _normalized("cursor"),
    "normalize_all": _normalized(
        None, "coalesce(moved_cost, cost)", "case when provider = 'openai' then 2 else 1 end"
    ),
    "validation_reasons": _with(*_BASE)
    + "select provider, reasons parse_reasons, '' store_reasons, count(*) arrivals from n group by all",
    "routed": _with(ARR, _PINNED) + "select seq, provider, version, parser_version from route",
    "registry": _with(ARR, _PINNED) + f"""select v.provider, v.version, '{_EXPECTS}' expects, v.latest,
      count(r.seq) arrivals from (values ('openai', 1, false), ('openai', 2, true), ('anthropic', 1, true),
      ('cursor', 1, true)) v(provider, version, latest)
      left join route r on r.provider = v.provider and r.parser_version = v.version group by all""",
    "leaf_paths": _with(*_BASE, SHAPES) + "select seq, path from n join leaves using (content_hash)",
    "path_set": _with(*_BASE, SHAPES)
    + "select seq, cast(n_paths as integer) n_paths, paths from n join shape using (content_hash)",
    "fingerprint": _with(*_BASE, SHAPES) + "select seq, provider, fingerprint from n join shape using (content_hash)",
    "payload_paths": _with(*_BASE, SHAPES) + "select seq, fingerprint from n join shape using (content_hash)",
    "known_shapes": _with(*_SHAPED) + "select provider, fingerprint, first_seq, n from known",
    "known_paths": _with(*_SHAPED) + """select provider, path, min(first_seq) since from (
      select provider, first_seq, unnest(string_split(fingerprint, chr(10))) path from known) group by all""",
    "dominant_shape": _with(*_SHAPED) + "select provider, fingerprint, n from usual",
    "props_shapes": """select event_type, fingerprint, min(event_id) first_event_id, count(*) n from (
      select event_id, event_type, array_to_string(list_sort(json_keys(props)), chr(10)) fingerprint from events)
      group by all""",
    "revisions": _with(*_FOLDED) + "select event_id, provider, revision, cast(cost as double) cost_amount_usd from ev",
    "ingest_results": _with(*_ALERTED) + f"""select r.seq, dedup_key, {_uuid('dedup_key')} event_id, inserted, revision,
      (select count(*) from al where al.seq = r.seq) alerts from results r""",
    "structural_alerts": _with(*_ALERTED) + """select seq, provider, severity, message, fingerprint, added, removed
      from al where type = 'STRUCTURAL'""",
    "field_stats": _with(*_RANKED) + """select provider, field, overall_seen, overall_populated, recent_seen,
      recent_populated from stats""",
    "silent_null_alerts": _with(*_RANKED) + f"""select provider, field,
      case when field = 'cost.amount_usd' then 'critical' else 'warn' end severity, {_DARK_MESSAGE} message,
      overall_populated / overall_seen overall_rate, recent_populated / recent_seen recent_rate, overall_seen, recent_seen
      from stats where overall_seen >= 30 and recent_seen >= 10 and overall_populated / overall_seen >= 0.9
      and recent_populated / recent_seen <= 0.1""",
    "silent_null_first_fire": _with(*_FOLDED, FIRE) + f"""select provider, field, t seq,
      case when field = 'cost.amount_usd' then 'critical' else 'warn' end severity, {_DARK_MESSAGE} message,
      overall_seen, overall_populated, recent_seen, recent_populated from fired""",
    "silent_null_by_version": _with(*_FOLDED, FIRE) + f"""
      , asking as (select provider, 'cost.amount_usd' field, seq from acc where provider = 'openai' and seq % 10 != 0),
      held as (select a.seq t, s.* exclude (t) from asking a asof join state s
        on a.provider = s.provider and a.field = s.field and a.seq >= s.t),
      judged as (select t, provider, field, overall_seen, overall_populated, recent_seen, recent_populated from held
        union all select t, provider, field, overall_seen, overall_populated, recent_seen, recent_populated from state
        where provider != 'openai' or field != 'cost.amount_usd')
      select provider, field, t seq, case when field = 'cost.amount_usd' then 'critical' else 'warn' end severity,
        {_DARK_MESSAGE} message, overall_seen, overall_populated, recent_seen, recent_populated
      from (select *, row_number() over (partition by provider, field order by t) rn from judged
        where overall_seen >= 30 and recent_seen >= 10 and overall_populated / overall_seen >= 0.9
        and recent_populated / recent_seen <= 0.1) where rn = 1""",
    "expected_field_stats": _with(*_RANKED) + """select provider, field, overall_seen, overall_populated, recent_seen,
      recent_populated from stats where field != 'cost.amount_usd' or provider not in (
        select provider from acc group by provider having provider = 'openai' and max(seq) % 10 = 0)""",
    "known_path_positions": _with(*_SHAPED) + """select provider, path, since,
        row_number() over (partition by provider order by since, path) - 1 as "position" from (
      select provider, path, min(first_seq) since from (
        select provider, first_seq, unnest(string_split(fingerprint, chr(10))) path from known) group by all)""",
    "alert_list": _with(*_ALERTED) + """select row_number() over (order by created_at desc, id desc) place, id, provider,
      type, severity, field, message, created_at from al""",
    "ingest_alerts": _with(*_ALERTED) + f"""select r.seq, {_uuid('dedup_key')} event_id, inserted, revision, l.alerts
      from results r join (select seq, string_agg(concat_ws(':', id, type, severity, field, message), ';' order by id) alerts
        from al group by seq) l using (seq)""",
    "exact_totals": """select event_type, count(*) events, cast(cast(sum(cast(
        cast(round("value" * 100) as bigint) || 'E' || (event_id % 29 - 14) as decimal(38,14))) as varchar) as double) total
      from events group by event_type""",
    "label_stats": """with r as (select d.doc_id, lang, quality, toxic,
      row_number() over (partition by lang order by d.doc_id desc) rn from documents d left join labels using (doc_id))
      select lang, 'quality' field, count(*) filter (where rn > 20) overall_seen,
        count(quality) filter (where rn > 20) overall_populated, count(*) filter (where rn <= 20) recent_seen,
        count(quality) filter (where rn <= 20) recent_populated from r group by lang
      union all select lang, 'toxic', count(*) filter (where rn > 20), count(toxic) filter (where rn > 20),
        count(*) filter (where rn <= 20), count(toxic) filter (where rn <= 20) from r group by lang""",
    "label_series": """with r as (select source, quality, toxic,
      row_number() over (partition by source order by d.doc_id desc) rn from documents d left join labels using (doc_id))
      select source, 'quality' field, string_agg(case when quality is null then '0' else '1' end, '' order by rn desc) series,
        avg(case when quality is null then 0 else 1 end) filter (where rn <= 20) rate from r where rn <= 40 group by source
      union all select source, 'toxic', string_agg(case when toxic is null then '0' else '1' end, '' order by rn desc),
        avg(case when toxic is null then 0 else 1 end) filter (where rn <= 20) from r where rn <= 40 group by source""",
    "replay_diff": _with(*_REPLAYED) + """select seq, provider, version, outcome,
      case when outcome = 'drift' then 'cost_value' else '' end changed from outcomes where version < 3""",
    "replay_matrix": _with(*_REPLAYED) + f"""select provider, version, total, ok, drift, throw, {_CELL_STATUS} status,
      case when throw > 0 then 'cost.amount_usd:required' else '' end throw_reasons from cells""",
    "replay_summary": _with(*_REPLAYED) + """select count(*) cells, cast(sum(ok) as bigint) ok,
      cast(sum(drift) as bigint) drift, cast(sum(throw) as bigint) throw, (select count(*) from corpus) corpus_size
      from cells where version < 3""",
    "replay_failures": _with(*_REPLAYED) + """, positions as (select seq, provider,
        row_number() over (partition by provider order by seq) - 1 payload from corpus)
      select o.provider, p.payload, o.version, cast(o.golden_cost as double) expected, null::double actual,
        'cost.amount_usd:required' reason
      from (select *, row_number() over (partition by provider order by version, seq) rn from outcomes
        where outcome = 'throw') o join positions p using (seq) where rn <= 8""",
    "replay_regressions": _with(*_REPLAYED) + """select provider, version, false differs, true throws, total, throw
      from cells where throw > 0""",
    "replay_grid": _with(*_REPLAYED) + f"""select provider, max(case when version = 1 then {_CELL_STATUS} end) v1,
      max(case when version = 2 then {_CELL_STATUS} end) v2, max(case when version = 3 then {_CELL_STATUS} end) v3
      from cells group by provider""",
    "provider_replay": _with(*_REPLAYED) + """select provider, max(total) historical, cast(sum(throw) as bigint) regressions,
      case when sum(throw) > 0 then 'failed' else 'passed' end status from cells group by provider""",
    "recent_events": _with(*_FOLDED)
    + f"select {_EVENT_SELECT} from ev order by ingested_at desc, first_seq desc limit 50",
    "provider_health": _with(*_FOLDED) + """select provider, count(*) events, max(parser_version) parser_version,
      max(ingested_at) last_ingest, max(occurred_at) last_occurred, count(*) filter (where cost is null) missing_cost
      from ev group by provider""",
    "provider_versions": _with(*_FOLDED) + """select provider, count(*) events, max(parser_version) parser_version,
      case when provider = 'openai' then '1,2' else '1' end registered_versions,
      case when provider = 'openai' then 2 else 1 end live_version from ev group by provider""",
    "weekly_cost": _with(*_FOLDED) + """select provider, cast(date_trunc('week', occurred_at) as date) as week,
      cast(coalesce(sum(cost), 0) as double) cost_usd, count(*) events from ev group by all""",
    "missing_cost": _with(*_FOLDED)
    + "select provider, count(*) filter (where cost is null) missing_cost from ev group by provider",
    "cost_integrity": _with(*_FOLDED) + """select events, missing_cost, (1.0::double - missing_cost / events) * 100 integrity,
      (1.0::double - missing_cost / events) * 100 >= 99 healthy
      from (select count(*) events, count(*) filter (where cost is null) missing_cost from ev)""",
    "weekly_grid": _with(*_FOLDED) + """, w as (select provider, cast(date_trunc('week', occurred_at) as date) as week,
        sum(cost) c from ev group by all)
      select week, cast(coalesce(sum(c) filter (where provider = 'openai'), 0) as double) openai,
        cast(coalesce(sum(c) filter (where provider = 'anthropic'), 0) as double) anthropic,
        cast(coalesce(sum(c) filter (where provider = 'cursor'), 0) as double) cursor,
        (select round(cast(sum(c) as double), 9) from w) total_usd,
        (select round(cast(max(c) as double), 9) from w) max_cell from w group by week""",
    "field_vitals": _with(*_RANKED, SERIES) + _VITAL,
    "dark_providers": _with(*_RANKED, SERIES, f"v as ({_VITAL})") + """select provider, any_dark,
      row_number() over (order by not any_dark, list_position(['openai', 'anthropic', 'cursor'], provider)) = 1 focus
      from (select provider, bool_or(state = 'dark') any_dark from v group by provider)""",
    "alert_counts": _with(*_ALERTED)
    + "select count(*) filter (where severity = 'critical') critical, count(*) total from al",
    "order_weekly": """select o_orderpriority, cast(date_trunc('week', o_orderdate) as date) as week,
      cast(sum(cast(o_totalprice as decimal(18,2))) as double) total_usd, count(*) orders from orders group by all""",
    "event_weekly": """select event_type, cast(date_trunc('week', ts) as date) as week,
      cast(sum(cast("value" as decimal(18,2))) as double) total_value, count(*) events from events group by all""",
    "alert_events": _with(*_INSPECTED) + "select id, provider, type, field, event_id from targets",
    "provider_focus_event": _with(*_INSPECTED) + "select provider, event_id from focus",
    "parser_match": _with(*_DESCRIBED) + """select event_id, array_to_string(populated, ',') populated,
      array_to_string(missing, ',') missing from described""",
    "canonical_nested": _with(*_FOLDED) + """select event_id, raw_user_id, input_tokens, output_tokens,
      cast(cost as double) amount_usd, revision from ev""",
    "structural_diff": _with(*_DESCRIBED) + """select event_id, changed, array_to_string(added, ',') added,
      array_to_string(removed, ',') removed from described""",
    "silent_null_analysis": _with(*_DESCRIBED) + """select event_id, dark_field field, historical_rate, recent_rate,
      silent status, series from described where silent is not null""",
    "field_series": _with(*_RANKED, SERIES) + "select provider, field, series from series",
    "related_alerts": _with(*_INSPECTED) + "select event_id, alert_ids from related",
    "event_alerts": _with(*_INSPECTED) + """select d.event_id, al.id alert_id, al.type, al.severity, al.field, al.message,
      al.created_at from described d join al on al.provider = d.provider and (
        (al.type = 'SILENT_NULL' and list_contains(d.missing, al.field)) or (al.type = 'STRUCTURAL' and d.changed))""",
    "strict_inspection": _with(*_DESCRIBED, REPLAY) + f""", refused as (select provider, version, golden_cost,
        row_number() over (partition by provider order by version, seq) rn, seq from outcomes where outcome = 'throw'),
      positions as (select seq, row_number() over (partition by provider order by seq) - 1 payload from corpus),
      failed as (select provider, string_agg(concat_ws(':', payload, version, cast(golden_cost as double),
          'cost.amount_usd:required'), ';' order by rn) failures
        from refused join positions using (seq) where rn <= 8 group by provider),
      sums as (select provider, cast(sum(throw) as bigint) regressions from cells group by provider)
      select event_id, provider, case when regressions > 0 then 'Replay Failed' else {_STATUS} end status,
        case when regressions > 0 then 'failed' else 'passed' end replay_status, historical_payloads, regressions,
        coalesce(failures, '') failures
      from described join sums using (provider) left join failed using (provider)""",
    "suggested_version": _with(*_DESCRIBED) + "select event_id, suggested_version from fixes",
    "event_status": _with(*_DESCRIBED) + f"select event_id, provider, {_STATUS} status from described",
    "event_timeline": _with(*_DESCRIBED, f"stages as ({_STAGES})")
    + "select event_id, s.stage stage, s.status status, s.detail detail, s.at as at from stages",
    "event_notes": _with(*_DESCRIBED) + f"""select d.event_id, {_CAUSE} root_cause, {_IMPACT} impact, {_FIX} suggested_fix,
      historical_payloads || ' historical ' || d.provider || ' payloads validate successfully.' replay
      from described d left join fixes f using (event_id)""",
    "event_inspection": _with(*_INSPECTED) + f"""select d.event_id, d.provider, {_STATUS} status,
      {_uuid('d.content_hash')} raw_payload_id, d.received_at, d.revision, cast(d.cost as double) amount_usd,
      array_to_string(missing, ',') missing, changed, silent silent_null, 'passed' replay_status, 8 stages,
      {_CAUSE} root_cause, {_FIX} suggested_fix, 0 failures, r.alert_ids
      from described d left join fixes f using (event_id) join related r using (event_id)""",
    "alert_inspection": _with(*_INSPECTED) + f"""select t.id, d.event_id, {_STATUS} status, {_CAUSE} root_cause, {_IMPACT} impact
      from targets t join described d using (event_id)""",
}

# The same tables, however many batches they came in.
ORACLE |= {
    "streamed_events": ORACLE["events"],
    "streamed_alerts": ORACLE["alerts"],
    "streamed_results": ORACLE["ingest_results"],
    "streamed_corpus": _with(*_STORED) + "select content_hash, provider, seq, payload from corpus",
}
