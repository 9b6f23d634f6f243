"""The same queries as SQL text, for comparison on the same tables."""

from __future__ import annotations

from gateledger.plans.catalog import BUCKET_CAPACITY, BUCKET_RATE, BUDGET_CAP, KEY, SEGMENT
from gateledger.schema import LATENCY_BUCKETS
from gateledger.sources.plants import PLANTS

D = """
d as (select 'main' as chain_id, event_id as seq, ts, epoch_us(ts) * 1000 as ts_ns, user_id,
  case user_id % 3 when 0 then 'human' when 1 then 'agent' else 'policy' end as owner_type,
  'u' || user_id::varchar as owner_id,
  case event_type when 'error' then 'block' when 'signup' then 'escalate'
    when 'purchase' then 'redact' else 'allow' end as decision,
  case event_id % 5 when 0 then 'owner_resolution' when 1 then 'prompt_injection'
    when 2 then 'classification_gate' when 3 then 'rate_limit' else 'regex_content' end as check_name,
  case event_id % 4 when 0 then 'admission' when 1 then 'inspection'
    when 2 then 'commitment' else 'record' end as stage,
  'sha256:' || sha256(props) as fingerprint, value as latency_ms, event_type, props
  from events)
"""


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(c.strip() for c in ctes) + "\n"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _mac(expr: str) -> str:
    ipad, opad = KEY.pads()
    return (
        f"sha256(unhex('{opad.hex()}') || "
        f"unhex(sha256(unhex('{ipad.hex()}') || encode({expr}))))"
    )


SQL: dict[str, str] = {}

SQL["decision_counts"] = "select count(*) as decisions from events"

SQL["decision_distribution"] = _with(D) + """
select k.decision, count(d.decision) as decisions,
  round(count(d.decision) * 100.0 / greatest((select count(*) from d), 1), 6) as percent
from (values ('allow'), ('block'), ('redact'), ('escalate')) k(decision)
left join d on d.decision = k.decision group by 1
"""

SQL["count_by_grouping_sets"] = _with(D) + """
select 'check' as field, check_name as value, count(*) as decisions from d group by 2
union all select 'owner', owner_type || ':' || owner_id, count(*) from d group by 2
union all select 'decision', decision, count(*) from d group by 2
union all select 'owner_type', owner_type, count(*) from d group by 2
union all select 'stage', stage, count(*) from d group by 2
"""

SQL["check_rollup"] = _with(D) + """
select check_name, decision, count(*) as decisions from d group by rollup(check_name, decision)
"""

SQL["top_checks"] = _with(D) + """
select check_name, count(*) as firings,
  count(distinct owner_type || ':' || owner_id) as distinct_owners,
  count(*) filter (decision = 'block') as blocks,
  count(*) filter (decision = 'escalate') as escalates,
  count(*) filter (decision = 'redact') as redacts
from d where decision <> 'allow' group by 1
order by firings desc, min(seq) limit 10
"""

SQL["top_blocked_owners"] = _with(D) + """
select 'owner_' || substr(sha256('pepper:' || owner_type || ':' || owner_id), 1, 16) as owner,
  count(*) as blocks
from d where decision = 'block' group by owner_type, owner_id
order by blocks desc, min(seq) limit 10
"""

_WIN = """
cur as (select * from d where ts between timestamp '2024-01-24' and timestamp '2024-01-31'),
pri as (select * from d where ts >= timestamp '2024-01-17' and ts < timestamp '2024-01-24')
"""

SQL["window_deltas"] = _with(D, _WIN) + """
select c.check_name, coalesce(p.n, 0) as prior, c.n as current,
  round(case when coalesce(p.n, 0) = 0 then 'inf'::double else (c.n - p.n) * 100.0 / p.n end, 6) as pct_delta
from (select check_name, count(*) as n, min(seq) as s from cur where decision <> 'allow' group by 1) c
left join (select check_name, count(*) as n from pri where decision <> 'allow' group by 1) p
  on p.check_name = c.check_name
order by c.n desc, c.s limit 10
"""

SQL["new_blocked_owners"] = _with(D, _WIN, """
ct as (select owner_type || ':' || owner_id as owner, count(*) as blocks from cur
  where decision = 'block' group by 1 order by 2 desc, min(seq) limit 10),
pt as (select owner_type || ':' || owner_id as owner, count(*) as blocks from pri
  where decision = 'block' group by 1 order by 2 desc, min(seq) limit 10)
""") + "select owner, blocks from ct where owner not in (select owner from pt)"

SQL["report_totals"] = _with(D, _WIN) + """
select decision, sum(c) as current, sum(p) as prior from (
  select decision, 1 as c, 0 as p from cur union all select decision, 0, 1 from pri) group by 1
"""

SQL["tail_filtered"] = _with(D) + """
select seq, check_name, owner_id from d where decision = 'block' and owner_type = 'agent'
order by seq desc limit 25
"""

SQL["show_entry"] = _with(D) + "select seq, 'E-17' as entry_id, decision from d where seq = 17"

SQL["request_trace"] = _with(D) + """
select fingerprint, seq, check_name, decision,
  row_number() over (partition by fingerprint order by seq) - 1 as trace_pos,
  count(*) over (partition by fingerprint) as trace_size
from d
"""

SQL["escalations_open"] = _with(D) + """
select owner_id, seq, decision, check_name from d e where decision = 'escalate'
and not exists (select 1 from d a where a.owner_id = e.owner_id and a.decision = 'allow' and a.seq > e.seq)
"""

SQL["shadow_join"] = _with(D) + """
select check_name, stage, decision, count(*) as decisions,
  count(*) filter (seq % 3 = 0 and decision <> 'allow') as shadowed
from d group by 1, 2, 3
"""

SQL["name_differences"] = """
with e as (select distinct p_name as name from part),
i as (select distinct p_name || case when p_size % 11 = 0 then '+' else '' end as name
  from part where p_size % 7 <> 0)
select name, 'missing' as side from (select name from e except select name from i)
union all select name, 'extra' from (select name from i except select name from e)
"""

_CHAIN = f"""
u as (select seq, 'main/' || lpad((seq // {SEGMENT})::varchar, 8, '0') as chain,
  seq % {SEGMENT} as pos,
  '{{"approval_chain":["' || owner_type || ':' || owner_id || '"],"check_name":"' || check_name
  || '","decision":"' || decision || '","entry_id":"e' || seq::varchar
  || '","metadata":{{"_anchor":{{"backend":"noop","success":true}},"_signing_key_id":"k1","stage":"' || stage
  || '"}},"owner_id":"' || owner_id || '","owner_type":"' || owner_type || '","prev_hmac":"' as head,
  '","reason":"rule ' || event_type || '","request_fingerprint":"' || fingerprint
  || '","ts_ns":' || ts_ns::varchar || '}}' as tail from d)
"""

_SEALED = f"""
r as (select chain, pos, '' as prev_hmac, {_mac("head || tail")} as hmac from u where pos = 0
  union all
  select u.chain, u.pos, r.hmac, {_mac("u.head || r.hmac || u.tail")}
  from r join u on u.chain = r.chain and u.pos = r.pos + 1)
"""
SQL["seal_segments"] = _with(D, _CHAIN, _SEALED, recursive=True) + """
select chain as chain_id, pos as seq, prev_hmac, hmac from r"""

_STAMP = '"_anchor":{"backend":"noop","success":true},"_signing_key_id":"k1",'
SQL["sealed_heads"] = _with(D, _CHAIN, _SEALED, f"""
e as (select (seq // {SEGMENT}) as segment, count(*) as n, max(ts_ns) as ts_ns from d group by 1),
g as (
  select segment as seq, 'segment_head' as check_name, 'main/' || segment::varchar as entry_id, ts_ns,
    '"last_hmac":"' || r.hmac || '","rows":' || n::varchar || ',"segment":' || segment::varchar as facts
  from e join r on r.chain = 'main/' || lpad(segment::varchar, 8, '0') and r.pos = n - 1
  union all
  select count(*), 'segments_closed', 'main/heads', max(ts_ns), '"segments":' || count(*)::varchar from e),
t as (select seq, entry_id,
    '{{"approval_chain":["policy:segments"],"check_name":"' || check_name || '","decision":"allow","entry_id":"' || entry_id
    || '","metadata":{{{_STAMP}' || facts || '}},"owner_id":"segments","owner_type":"policy","prev_hmac":"' as head,
    '","reason":"segment sealed","request_fingerprint":"","ts_ns":' || ts_ns::varchar || '}}' as tail from g),
h as (
  select seq, entry_id, '' as prev_hmac, {_mac("head || tail")} as hmac from t where seq = 0
  union all
  select t.seq, t.entry_id, h.hmac, {_mac("t.head || h.hmac || t.tail")} from h join t on t.seq = h.seq + 1)
""", recursive=True) + "select 'main/heads' as chain_id, seq, entry_id, prev_hmac, hmac from h"

SQL["linked_segment_breaks"] = f"""
select 'main/' || lpad(k::varchar, 8, '0') as chain_id, k as "index", '' as entry_id,
  case when k % 5 = 2 then 'segment_missing' else 'segment_changed' end as kind
from (select distinct event_id // {SEGMENT} as k from events) where k % 5 = 2 or k % 7 = 3
"""

_TAMPER = f"""
k as (select 'main/' || lpad((event_id // {SEGMENT})::varchar, 8, '0') as chain_id, event_id as n,
  event_id % {SEGMENT} as pos from events where event_id % 389 <> 5),
s as (select chain_id, n, row_number() over w - 1 as idx,
  coalesce(lag(pos) over w, -1) <> pos - 1 as link_bad, n % 97 = 11 as edited
  from k window w as (partition by chain_id order by pos))
"""

SQL["chain_breaks"] = _with(_TAMPER) + """
select chain_id, idx as "index", 'e' || n::varchar as entry_id, 'link_mismatch' as kind from s where link_bad
union all
select chain_id, idx, 'e' || n::varchar, 'self_mismatch' from s where edited and not link_bad
"""

SQL["verification_report"] = _with(_TAMPER) + """
select chain_id, count(*) as total_entries, count(*) filter (link_bad or edited) as breaks,
  coalesce(max(idx) filter (not edited), -1) as last_good_index,
  count(*) filter (link_bad or edited) = 0 as ok
from s group by 1
"""

SQL["link_cascades"] = """
with b as (select event_id as seq, event_id > 0 and
    event_id % 50 between 10 and 10 + (event_id // 50) % 5 as bad from events),
f as (select seq, bad, coalesce(lag(bad) over (order by seq), false) as before from b),
g as (select seq, sum(case when not before then 1 else 0 end) over (order by seq) as run from f where bad),
r as (select run, min(seq) as first, count(*) as n from g group by 1)
select 'main' as chain_id, first as "index", 'link_mismatch' as kind, 0 as suppressed from r
union all select 'main', first + 1, 'cascade_suppressed', n - 1 from r where n > 1
"""

SQL["hmac_self"] = f"""
select event_id, {_mac("event_id::varchar || '|' || event_type || '|' || props")} as mac from events
"""

SQL["fingerprints"] = """
select event_id, case when event_id % 9 > 0 then 'sha256:' || sha256(props) else '' end as fingerprint,
  'owner_' || substr(sha256('s:human:u' || user_id::varchar), 1, 16) as owner from events
"""

SQL["merkle_root"] = """
with recursive leaf as (select event_id as i,
    sha256(sha256(event_id::varchar || '/' || props)) as h from events),
t as (select 0 as lvl, list(h order by i) as hs from leaf
  union all
  select lvl + 1, list_transform(range(0, len(hs), 2),
    lambda i: sha256(unhex(hs[i + 1]) || unhex(hs[least(i + 2, len(hs))])))
  from t where len(hs) > 1)
select 'main' as chain_id, (select count(*) from events) as leaf_count, hs[1] as root
from t where len(hs) = 1
"""

SQL["log_round_trip"] = _with(D, """
o as (select *, row_number() over (order by seq) - 1 as n from d),
k as (select * from o where n % 50 not in (7, 9, 11))
""") + """
select row_number() over (order by n) - 1 as seq, 'e' || n::varchar as entry_id, owner_type, owner_id, decision,
  check_name, ts_ns, 64 as mac_length from k
"""

SQL["malformed_lines"] = _with(D, "o as (select row_number() over (order by seq) - 1 as n from d)") + """
select n + 1 as line_number, case n % 50 when 7 then 'invalid JSON' else 'unknown decision' end as parse_error
from o where n % 50 in (7, 9)
"""

SQL["unknown_keys"] = _with(D) + f"select 'e' || seq::varchar as entry_id, 'k0' as key_id from d where seq // {SEGMENT} % 3 = 1"

SQL["effective_top_checks"] = _with(D, """
e as (select *, case when seq % 3 < 2 then check_name else 'pipeline.' || stage end as named from d)
""") + """
select named as check_name, count(*) as firings,
  count(distinct owner_type || ':' || owner_id) as distinct_owners,
  count(*) filter (decision = 'block') as blocks,
  count(*) filter (decision = 'escalate') as escalates,
  count(*) filter (decision = 'redact') as redacts
from e where decision <> 'allow' group by 1
order by firings desc, min(seq) limit 10
"""

SQL["key_eras"] = f"""
select 'main/' || lpad((event_id // {SEGMENT})::varchar, 8, '0') as chain_id,
  case event_id // {SEGMENT} % 3 when 1 then 'k0' else 'k1' end as key_id,
  count(*) as rows, min(event_id % {SEGMENT}) as first_seq, max(event_id % {SEGMENT}) as last_seq,
  count(*) filter (event_id % {SEGMENT} % 97 = 11) as failed from events group by 1, 2
"""

SQL["anchor_coverage"] = f"""
select case event_id % {SEGMENT} % 10 when 7 then 'none' else 'noop' end as backend,
  event_id % {SEGMENT} % 10 not in (3, 7) as success, count(*) as rows from events group by 1, 2
"""

_ONE = 10**12
_RATE = round(BUCKET_RATE * 1_000_000)
_FULL = BUCKET_CAPACITY * _ONE

SQL["token_bucket"] = _with(f"""
e as (select 'u' || user_id::varchar as o, event_id as id, epoch_us(ts)::hugeint as us,
  row_number() over (partition by user_id order by ts, event_id) as rn from events),
r as (select o, id, us, rn, true as ok, {_FULL - _ONE}::hugeint as tok from e where rn = 1
  union all
  select o, id, us, rn, avail >= {_ONE}, case when avail >= {_ONE} then avail - {_ONE} else avail end
  from (select e.o, e.id, e.us, e.rn,
    least({_FULL}::hugeint, r.tok + (e.us - r.us) * {_RATE}) as avail
    from r join e on e.o = r.o and e.rn = r.rn + 1))
""", recursive=True) + f"""
select o as owner_key, id as request_id, ok as allowed,
  case when ok then round(tok::double / {_ONE}, 3) end as tokens_remaining
from r
"""

SQL["hard_quota"] = """
select 'u' || user_id::varchar as owner_key, event_id as request_id,
  row_number() over (partition by user_id order by ts, event_id) <= 40 as allowed from events
"""

_DAY = 86_400_000_000

SQL["token_budget"] = _with(f"""
e as (select 'u' || user_id::varchar as o, event_id as id, epoch_us(ts) as us,
  round(value)::bigint as amt,
  row_number() over (partition by user_id order by ts, event_id) as rn from events),
r as (select o, id, us, rn, amt, us as start_us, 0::bigint as before,
    amt <= {BUDGET_CAP} as ok, case when amt <= {BUDGET_CAP} then amt // 2 else 0 end as used
  from e where rn = 1
  union all
  select o, id, us, rn, amt, start_us, before, before + amt <= {BUDGET_CAP},
    before + case when before + amt <= {BUDGET_CAP} then amt // 2 else 0 end
  from (select e.o, e.id, e.us, e.rn, e.amt,
      case when e.us - r.start_us >= {_DAY} then e.us else r.start_us end as start_us,
      case when e.us - r.start_us >= {_DAY} then 0 else r.used end as before
    from r join e on e.o = r.o and e.rn = r.rn + 1))
""", recursive=True) + """
select o as owner_key, id::varchar as request_id, ok, before as budget_used,
  case when ok then amt else 0 end as budget_reserved from r
"""

SQL["window_usage"] = f"""
select 'u' || user_id::varchar as owner_key, event_id as request_id,
  sum(round(value)::bigint) over w as used, sum(round(value)::bigint) over w > {BUDGET_CAP} as over
from events window w as (partition by user_id, date_trunc('day', ts) order by ts, event_id)
"""

_HEADERS = """
c as (select c_custkey as request_id, c_custkey % 4 as k, c_name, c_mktsegment, c_nationkey,
  case when c_custkey % 8 = 2 then c_mktsegment || '@v' || c_nationkey::varchar else c_mktsegment end as pol,
  case c_nationkey % 6 when 0 then 'UNCLASS' when 1 then 'CUI' when 2 then 'SECRET' when 3 then 'TS'
    when 4 then 'TS/SCI' else 'BOGUS' end as needs_raw,
  case c_custkey % 6 when 0 then 'UNCLASS' when 1 then 'CUI' when 2 then 'SECRET' when 3 then 'TS'
    when 4 then 'TS/SCI' else 'BOGUS' end as holds_raw,
  nullif(c_nationkey % 6, 5) as needs, nullif(c_custkey % 6, 5) as holds,
  case c_custkey // 4 % 4 when 0 then '127' when 1 then '100' when 2 then '10' else '8' end
    || '.' || ((c_nationkey * 5) % 256)::varchar || '.0.' || (c_custkey % 256)::varchar as ip
  from customer)
"""

SQL["owner_resolution"] = _with(_HEADERS) + """
select request_id, case k when 0 then 'human' when 1 then 'agent' when 2 then 'policy' else 'unresolved' end as owner_type,
  case k when 0 then c_name when 1 then 'a' || request_id::varchar when 2 then pol else '' end as owner_id,
  case when k = 3 then 'block' else 'allow' end as decision,
  case k when 0 then 'owner resolved: human:' || c_name
    when 1 then 'owner resolved: agent:a' || request_id::varchar
    when 2 then 'owner resolved: policy:' || pol
    else 'no commit owner could be resolved' end as reason
from c
"""

SQL["loopback_trust"] = _with(_HEADERS, """
t as (select *, case when k <> 3 then null when ip like '127.%' then 'internal-loopback'
    when ip like '100.%' and octet between 64 and 127 then 'internal-tailnet:' || ip
    when ip like '10.%' and octet < 64 then 'internal-trusted:' || ip end as trusted
  from (select *, split_part(ip, '.', 2)::int as octet from c))
""") + """
select request_id, case when trusted is not null then 'policy'
    when k = 0 then 'human' when k = 1 then 'agent' when k = 2 then 'policy' else 'unresolved' end as owner_type,
  case when trusted is not null then trusted
    when k = 0 then c_name when k = 1 then 'a' || request_id::varchar when k = 2 then pol else '' end as owner_id,
  case when trusted is not null then 'trusted source ' || ip || '; resolved to policy:' || trusted else '' end as reason
from t
"""

SQL["network_owners"] = """
with n as (select o_orderkey as n, [12, 16, 20, 24, 28, 32][o_orderkey % 6 + 1] as len,
    o_orderkey % 1000003 * 2654435761 % 4294967296 as num,
    o_orderkey % 65536 * 7919 % 65536 as grp, o_orderkey % 64 as low from orders),
four as (select n, len, num // (1::bigint << (32 - len)) as prefix,
    num - num % (1::bigint << (32 - len)) as first from n where n % 5 <> 0),
nets as (
  select n, 4 as kind, len, prefix, (first >> 24)::varchar || '.' || ((first >> 16) & 255)::varchar || '.'
    || ((first >> 8) & 255)::varchar || '.' || (first & 255)::varchar || '/' || len::varchar as network from four
  union all
  select n, 6, case when n % 2 = 0 then 48 else 64 end, case when n % 2 = 0 then grp else grp * 65536 + low end,
    '2001:db8:' || upper(to_hex(grp)) || case when n % 2 = 0 then '::/48' else ':' || upper(to_hex(low)) || '::/64' end
  from n where n % 5 = 0),
a as (select event_id, event_id % 1000003 * 2246822519 % 4294967296 as num,
    event_id * 5 % 65536 * 7919 % 65536 as grp, event_id % 64 as low,
    case when event_id % 50 in (7, 9) then 0 when event_id % 4 = 0 then 6 else 4 end as kind from events),
k as (
  select event_id, 4 as kind, len, num // (1::bigint << (32 - len)) as prefix
  from a, (values (12), (16), (20), (24), (28), (32)) l(len) where kind = 4
  union all select event_id, 6, 48, grp from a where kind = 6
  union all select event_id, 6, 64, grp * 65536 + low from a where kind = 6),
best as (select event_id, min(n) as n from k join nets using (kind, len, prefix) group by 1)
select event_id, case when event_id % 50 = 7 then 'host-' || event_id::varchar when a.kind = 4 then
    (num >> 24)::varchar || '.' || ((num >> 16) & 255)::varchar || '.' || ((num >> 8) & 255)::varchar || '.' || (num & 255)::varchar
  when a.kind = 6 then '2001:DB8:' || upper(to_hex(grp)) || ':' || upper(to_hex(low)) || '::' || upper(to_hex(event_id % 65536)) end as client_ip,
  nets.network, 'team-' || (best.n % 97)::varchar as team
from a left join best using (event_id) left join nets on nets.n = best.n
"""

SQL["rule_table_matches"] = """
with t as (select distinct doc_id, unnest(string_split_regex(text, '[^A-Za-z]+')) as word from documents),
r as (select distinct word as rule_id, lower(word) as low, length(word) % 3 = 0 as any_case
  from t where doc_id % 2 = 0 and length(word) >= 9),
m as (select distinct doc_id, rule_id from t join r on r.low = lower(t.word) where any_case or r.rule_id = t.word)
select doc_id, count(*) as rules, min(rule_id) as first_rule from m group by 1
"""

_NAMES = "['UNCLASS', 'CUI', 'SECRET', 'TS', 'TS_SCI']"
SQL["classification_gate"] = _with(_HEADERS) + f"""
select request_id, case when needs is null or holds is null or holds < needs then 'block' else 'allow' end as decision,
  case when needs is null then 'unrecognized classification header value: ''' || needs_raw || ''''
    when holds is null then 'unrecognized clearance header value: ''' || holds_raw || ''''
    when holds < needs then 'caller clearance ' || {_NAMES}[holds + 1]
      || ' insufficient for data classification ' || {_NAMES}[needs + 1]
    else 'clearance ' || {_NAMES}[holds + 1] || ' cleared for ' || {_NAMES}[needs + 1] end as reason
from c
"""

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SQL["redact_pii"] = rf"""
select doc_id, case when token then 'block' when mail then 'redact' else 'allow' end as decision,
  case when token then 'pattern ''token'' matched' when mail then 'pattern ''email'' redacted' else '' end as reason,
  case when not token and mail then md5(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g')) end as redacted_md5
from (select doc_id, text, regexp_matches(text, '\b[0-9a-f]{{32,}}\b') as token,
  regexp_matches(text, '{_EMAIL}') as mail from documents)
"""

# The rules in RE2 form.
_RULES = [
    ("ignore_previous", "high",
     r"(?i)ignore\b[^.!?\n]{0,80}?\b(?:instructions?|prompts?|rules?|messages?|(?:system\s+)?prompt|directives?)\b"),
    ("disregard", "high", r"(?i)disregard\s+(?:the\s+)?(?:above|previous|prior|all)\b"),
    ("forget_prompt", "high", r"(?i)forget\s+(?:everything|your\s+(?:prompt|instructions|training))\b"),
    ("inline_system_role", "high", r"(?i)<\|(?:im_start|system|im_sep)\|>"),
    ("inline_role_marker", "medium", r"(?im)^\s*(?:system|assistant)\s*:\s*"),
    ("dan_jailbreak", "high", r"(?i)\b(?:DAN|do\s+anything\s+now|jailbroken|jailbreak\s+mode)\b"),
    ("jailbreak_keyword", "high", r"(?i)jail[\s_-]?break(?:s|en|ing|er|ed)?\b"),
    ("developer_mode", "high", r"(?i)(?:developer|god|admin|root)\s+mode\s+(?:enabled|on|activated)\b"),
    ("no_restrictions", "high",
     r"(?i)(?:act|behave|respond)\s+as\s+if\s+you\s+have\s+no\s+(?:restrictions|limits|filters|rules)\b"),
    ("zero_width", "medium", r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"),
    ("bidi_override", "high", r"[\x{202a}-\x{202e}\x{2066}-\x{2069}]"),
]

_PLANTED = (
    "p as (select doc_id, text || case doc_id % 11 "
    + " ".join(f"when {i} then {_quote(p)}" for i, p in enumerate(PLANTS))
    + " else '' end as text from documents)"
)
_HITS = "h as (" + "\nunion all ".join(
    f"select doc_id, {_quote(n)} as rule, '{s}' as severity, {i} as pos from p where regexp_matches(text, {_quote(r)})"
    for i, (n, s, r) in enumerate(_RULES)
) + ")"

SQL["injection_rules"] = _with(_PLANTED, _HITS) + "select doc_id, rule, severity from h"

SQL["rules_hit"] = _with(_PLANTED, _HITS) + """
select p.doc_id, coalesce(string_agg(h.rule, ',' order by h.rule), '') as rules
from p left join h on h.doc_id = p.doc_id group by 1
"""

_VERDICT = """
w as (select doc_id, min_by(rule, (case severity when 'high' then 0 else 100 end) + pos) as rule,
  min_by(severity, (case severity when 'high' then 0 else 100 end) + pos) as severity from h group by 1),
v as (select p.doc_id, case w.severity when 'high' then 'block' when 'medium' then 'escalate' else 'allow' end as decision,
  case when w.rule is null then '' else 'prompt-injection rule ''' || w.rule || ''' fired (' || w.severity || ')' end as reason
  from p left join w on w.doc_id = p.doc_id)
"""

SQL["injection_verdicts"] = _with(_PLANTED, _HITS, _VERDICT) + "select doc_id, decision, reason from v"

# Layers of encodings: the channels of the cascade, applied until nothing new turns up.


def _runs(pattern: str, decode: str, glue: str = "chr(10)") -> str:
    listed = f"list_filter(list_transform(regexp_extract_all(text, {_quote(pattern)}), lambda r: {decode}), lambda d: d is not null)"
    return f"case when len({listed}) > 0 then array_to_string({listed}, {glue}) end"


def _clean(raw: str) -> str:
    plain = (
        f"decode(unhex(array_to_string(list_filter(regexp_extract_all(hex({raw}), '..'), "
        "lambda h: (h >= '20' and h <= '7E') or h in ('09', '0A', '0D')), '')))")
    text = f"coalesce(regexp_replace(try(decode({raw})), '[\\x00-\\x08\\x0e-\\x1f]', '', 'g'), {plain})"
    return f"case when regexp_matches({text}, '[ -~]{{3}}') then {text} end"


def _in_place(mark: str, pattern: str, code: str) -> str:
    part = f"regexp_extract(q, '^{pattern}', 1)"
    whole = (
        f"array_to_string(list_transform(string_split(text, {_quote(mark)}), lambda q, i: case when i = 1 then q "
        f"when {part} <> '' then chr({code.format(part)}) || regexp_replace(q, '^{pattern}', '') "
        f"else {_quote(mark)} || q end), '')")
    return f"case when contains(text, {_quote(mark)}) then {whole} end"


_B64 = "translate(rtrim(translate(r, '-_=', '+/ ')), ' ', '')"
_B64 = f"case when len({_B64}) % 4 <> 1 then from_base64(rpad({_B64}, (ceil(len({_B64}) / 4.0) * 4)::int, '=')) end"
_HEXED = "cast('0x' || {0} as int)"
_CHANNELS_SQL = {
    "base64": _runs("[A-Za-z0-9+/_-]{16,}={0,2}", _clean(_B64)),
    "hex": _runs("(=?[0-9A-Fa-f][0-9A-Fa-f][ :,-]?){8,}", _clean("unhex(translate(r, '= :,-', ''))")),
    "percent": _runs(r"[^\s%]*(%[0-9A-Fa-f][0-9A-Fa-f][^\s%]*)+", "try(url_decode(replace(r, '+', '%2B')))", "' '"),
    "entity": _in_place("&#", r"(\d{1,7});", "cast({0} as int)"),
    "hex-entity": _in_place("&#x", "([0-9A-Fa-f]{{1,6}});".replace("{{", "{").replace("}}", "}"), _HEXED),
    "escape": _in_place("\\u", "([0-9A-Fa-f]{4})", _HEXED),
    "curly-escape": _in_place("\\u{", r"([0-9A-Fa-f]{1,6})\}", _HEXED),
    "code-points": _runs(
        r"(\d\d\d?[ ,;]+){7,}\d\d\d?",
        "array_to_string(list_transform(regexp_split_to_array(r, '[ ,;]+'), lambda d: chr(cast(d as int))), '')"),
    "spread": _runs("([A-Za-z0-9+/] ){15,}[A-Za-z0-9+/=]", "translate(r, ' ', '')"),
}
# Letters moved on by 1 to 25 and mirrored; all printable signs moved on by 47.
_ABC = "'abcdefghijklmnopqrstuvwxyz'"
_ASCII = "list_aggregate(list_transform(range(33, 127), lambda k: chr(k::int)), 'string_agg', '')"
_CIPHERS_SQL = f"""
  with l as (select {_ABC} as l, {_ASCII} as g),
  t as (
    select l, substr(l, k::int + 1) || substr(l, 1, k::int) as m from l, range(1, 26) as r(k)
    union all select l, reverse(l) from l)
  select l || upper(l) as signs, m || upper(m) as turned from t
  union all select g, substr(g, 48) || substr(g, 1, 47) from l
"""
_LAYERS = f"""
c as ({_CIPHERS_SQL}),
f as (
  select doc_id, false as cipher, text from p
  union
  (with g as (select doc_id, cipher, text from f)
   select doc_id, cipher, made as text
   from (select doc_id, cipher, text, unnest([{", ".join(_CHANNELS_SQL.values())}]) as made from g)
   where made is not null and made <> text
   union all
   select doc_id, true, translate(text, signs, turned) from g, c where not cipher
   union all
   select doc_id, true, reverse(text) from g where not cipher)
)
"""
SQL["decode_cascade"] = "with recursive " + ",\n".join([_PLANTED, _LAYERS, _HITS.replace("from p where", "from f where"), """
w as (select doc_id, min(case severity when 'high' then 0 else 1 end) as worst,
  string_agg(distinct rule, ',' order by rule) as rules from h group by 1)
"""]) + """
select p.doc_id, case worst when 0 then 'block' when 1 then 'escalate' else 'allow' end as decision,
  coalesce(rules, '') as rules from p left join w on w.doc_id = p.doc_id
"""

SQL["scanner_quality"] = _with(_PLANTED, _HITS, _VERDICT, """
l as (select doc_id, doc_id % 11 in (0, 1, 2, 3, 4, 6) as expected,
  coalesce(['plain', 'base64', 'hex', 'rot13', 'html', 'marker', 'role'][doc_id % 11 + 1], 'none') as channel from p)
""") + """
select channel, count(*) filter (expected) as attacks,
  count(*) filter (expected and decision <> 'allow') as caught,
  count(*) filter (not expected) as benign,
  count(*) filter (not expected and decision <> 'allow') as false_positives
from l join v on v.doc_id = l.doc_id group by 1
"""


def _folds() -> tuple[str, str]:
    from gateledger.functions.text import CONFUSABLES

    return "".join(CONFUSABLES), "".join(CONFUSABLES.values())


SQL["scan_text_forms"] = f"""
select doc_id, length(translate(text, '*_~\\', '')) as md_len,
  length(regexp_replace(text, '[\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}\\x{{180e}}\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}\\x{{ad}}]', '', 'g')) as zw_len,
  md5(translate(text, {_quote(_folds()[0])}, {_quote(_folds()[1])})) as folded_md5 from documents
"""

_MARKERS = [
    ("TOP SECRET//SCI", 4), ("SECRET//NOFORN", 2), ("(CONFIDENTIAL)", 1), ("(TOP SECRET)", 3),
    ("SECRET//REL", 2), ("(TS//SCI)", 4), ("(U//FOUO)", 1), ("TS//SCI", 4), ("(S//NF)", 2),
    ("(SECRET)", 2), ("//NOFORN", 2), ("//ORCON", 2), ("//IMCON", 2), ("//FVEY", 2), ("CUI//", 1),
    ("(TS)", 3), ("FOUO", 1), ("(S)", 2), ("(C)", 1), ("(U)", 0),
]
_MARKER_RE = "(?i)" + "|".join(
    m.replace("(", r"\(").replace(")", r"\)") for m, _ in _MARKERS
)
_LEVEL_OF = "case " + " ".join(f"when lower(m) = '{m.lower()}' then {n}" for m, n in _MARKERS) + " end"

_DRIFT = f"""
t as (select conv_id as request_id, turn::int as chunk_idx, turn,
  case when conv_id % 5 = 1 and turn = 1 then 'FORN ' else '' end || text
  || case when conv_id % 5 = 1 and turn = 0 then ' SECRET//NO'
    when (conv_id + turn) % 7 = 3 then ' (U) fouo' else '' end as text,
  (100 + conv_id % 7 * 100) as max_tokens, conv_id % 3 as request_level from conversations),
a as (select *, sum(length(text)) over (partition by request_id order by turn) as chars,
  right(coalesce(string_agg(text, '') over (partition by request_id order by turn
    rows between unbounded preceding and 1 preceding), ''), 14) || text as tail from t),
b as (select *, (select max({_LEVEL_OF}) from unnest(regexp_extract_all(tail, {_quote(_MARKER_RE)})) u(m)) as level from a),
s as (select request_id, chunk_idx, least(chars, 1048576) as accumulated_chars,
  case when least(chars, 1048576) > floor(max_tokens * 4 * 1.1) then 'token_count'
    when text <> '' and level > request_level then 'classification' end as kind, level from b)
"""

SQL["regex_output"] = """
select request_id, chunk_idx, case when hit then 'block' else 'allow' end as decision,
  case when hit then 'pattern ''word'' matched' else '' end as reason
from (select conv_id as request_id, turn as chunk_idx, regexp_matches(string_agg(case when turn % 5 = 3 then '' else text end, '')
  over (partition by conv_id order by turn), 'th[a-z]{2}re') as hit from conversations)
"""

SQL["regex_output_long"] = """
select request_id, chunk_idx, case when label is null then 'allow' else 'block' end as decision,
  case when label is null then '' else concat('pattern ', chr(39), label, chr(39), ' matched') end as reason
from (select request_id, chunk_idx, case when regexp_matches(grown, '[a-z]ing,[^!?;:]*[a-z]ing,') then 'far'
    when regexp_matches(grown, 'th[a-z]{2}re') then 'word'
    when regexp_matches(grown, '(?i)ung [a-zß-ÿ]+[^,]*ung[.]') then 'tail' end as label
  from (select conv_id as request_id, turn as chunk_idx, string_agg(text, '')
    over (partition by conv_id order by turn) as grown from conversations))
"""

SQL["scope_drift"] = _with(_DRIFT) + """
select request_id, chunk_idx, accumulated_chars,
  case when kind is null then 'allow' else 'block' end as decision, kind,
  case when kind = 'classification' then level::varchar end as marker_level from s
"""

SQL["first_abort"] = _with(_DRIFT, """
x as (select request_id, min(chunk_idx) as abort_chunk from s where kind is not null group by 1)
""") + """
select s.request_id, coalesce(any_value(x.abort_chunk), count(*)) as chunks_delivered,
  any_value(x.abort_chunk) as abort_chunk,
  any_value(x.abort_chunk) = max(s.chunk_idx) as at_end_of_stream
from s left join x on x.request_id = s.request_id group by 1
"""

SQL["continuing_consent"] = """
select conv_id as request_id, turn::int as chunk_idx,
  case when due and off then 'block' else 'allow' end as decision,
  case when not due then '' when off then 'owner consent withdrawn during stream'
    else 'continuing consent verified' end as reason
from (select conv_id, turn, turn % 2 = 0 as due,
  conv_id % 4 = 1 and turn * 60 >= 90 and not (conv_id % 8 = 1 and turn * 60 >= 200) as off from conversations)
"""

SQL["tool_gate"] = """
with r as (select p_partkey as tool, p_size % 4 as tier, p_partkey % 2 = 1 as irr from part where p_partkey % 10 <> 9),
j as (select l_orderkey::varchar || '-' || l_linenumber::varchar as call_id, l_partkey as tool_name,
  r.tier, r.irr, l_suppkey, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][r.tier + 1] as nm
  from lineitem left join r on r.tool = l_partkey)
select call_id, tool_name,
  case when tier is null or tier = 3 then 'block' when irr and tier >= 2 then 'escalate' else 'allow' end as decision,
  'tool ''' || tool_name::varchar || case when tier is null then ''' not in registry'
    when tier = 3 then ''' is CRITICAL tier and allow_critical=False'
    when irr and tier >= 2 then ''' is irreversible and tier ' || nm || ' >= escalate-at HIGH'
    else ''' cleared (tier=' || nm || ')' end as reason,
  case when irr and tier = 2 then 'human:s' || l_suppkey::varchar end as approver
from j
"""

SQL["sandbox_preview"] = """
select o_orderkey as call_id,
  case when o_custkey % 5 = 0 then 'escalate' when o_orderkey % 13 = 0 or o_orderkey % 17 = 0 then 'block'
    when o_orderstatus = 'F' then 'escalate' else 'allow' end as decision,
  case when o_custkey % 5 = 0 then 'tool ''' || o_custkey::varchar || ''' does not support a preview run'
    when o_orderkey % 13 = 0 then 'sandbox preview failed: no preview'
    when o_orderkey % 17 = 0 then 'sandbox preview failed: timeout'
    when o_orderstatus = 'F' then 'sandbox preview of ''' || o_custkey::varchar || ''' looks unsafe'
    else 'sandbox preview ok' end as reason
from orders
"""

SQL["tribunal"] = """
with v as (select o_orderkey as request_id,
  case when o_orderkey % 11 <> 0 and o_orderstatus <> 'F' then 'ALLOW' else 'BLOCK' end as a,
  case when o_orderpriority < '3' then 'ALLOW' else 'BLOCK' end as b from orders)
select request_id, case when a <> b then 'escalate' when a = 'ALLOW' then 'allow' else 'block' end as decision,
  case when a <> b then 'tribunal dissent: judge_a=' || a || ', judge_b=' || b
    when a = 'ALLOW' then 'tribunal: both judges allow' else 'tribunal: both judges block' end as reason
from v
"""

SQL["decision_counters"] = _with(D) + """
select check_name, stage, decision, count(*) as total from d group by 1, 2, 3
"""

SQL["latency_histogram"] = _with(D) + "select check_name, stage, decision, " + ", ".join(
    f"count(*) filter (latency_ms / 100 <= {b:g}) as le_{f'{b:g}'.replace('.', '_')}" for b in LATENCY_BUCKETS
) + """, count(latency_ms) as le_inf, round(sum(latency_ms / 100), 4) as total_seconds,
  count(latency_ms) as observations from d group by 1, 2, 3
"""

SQL["latency_percentiles"] = _with(D) + """
select stage, round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95,
  round(quantile_cont(latency_ms, 0.99), 6) as p99, round(max(latency_ms), 6) as max, count(latency_ms) as count
from d group by 1
"""

SQL["latency_overhead"] = _with(D) + "select " + ", ".join(
    f"round(quantile_cont(latency_ms, {p / 100}) filter (seq % 2 = 0) - "
    f"quantile_cont(latency_ms, {p / 100}) filter (seq % 2 = 1), 6) as p{p}" for p in (50, 95, 99)
) + " from d"

SQL["session_summary"] = """
select user_id, epoch_us(min(ts)) as created_us, epoch_us(max(ts)) as last_seen_us,
  count(*) as request_count, max(event_id % 5) as high_water_mark from events group by 1
"""

SQL["check_latency"] = _with(D) + """
select check_name, round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95,
  round(quantile_cont(latency_ms, 0.99), 6) as p99, round(max(latency_ms), 6) as max, count(*) as count
from d group by 1
"""

SQL["stage_latency"] = _with(D, """
x as (select s.stage, case when s.stage = d.stage then latency_ms else 0.0 end as v
  from d, (values ('admission'), ('inspection'), ('commitment'), ('record')) s(stage))
""") + """
select stage, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.95), 6) as p95,
  round(quantile_cont(v, 0.99), 6) as p99, round(max(v), 6) as max, count(*) as count from x group by 1
"""

SQL["latency_gate"] = """
select r.pct as percent, r.lim as limit_seconds,
  round((select quantile_cont(value / 1000, [0.5, 0.95, 0.99]) from events)[r.i], 6) as observed,
  (select quantile_cont(value / 1000, [0.5, 0.95, 0.99]) from events)[r.i] <= r.lim as passed
from (values (1, 50, 0.04::double), (2, 95, 0.2::double), (3, 99, 0.15::double)) r(i, pct, lim)
"""

SQL["realtime_totals"] = """
with b as (select user_id, max(ts) as until, arg_max(event_id, (event_id % 50 = 0, ts)) as best from events group by 1)
select user_id as session_id, best as function_calls_count, best + 7 as binary_frames_received,
  best % 17 as close_code, best % 50 = 0 as complete,
  round((epoch_us(until) - 1704067200000000) / 1e6, 3) as duration_seconds from b
"""

_REQ = """
q as (select conv_id * 100 + turn as request_id, (conv_id * 100 + turn) % 12 as k,
  (conv_id * 100 + turn) % 5 = 1 as bad_session, role, text from conversations),
p as (select *, case when bad_session then 'session_id_invalid_charset' when k = 0 then 'empty_body'
  when k = 1 then 'non_object_body' when k = 2 then 'json_decode_error' when k = 3 then 'non_finite_float'
  when k = 4 then 'json_too_deeply_nested' end as refusal_kind from q)
"""

SQL["preflight"] = _with(_REQ) + "select request_id, refusal_kind from p where refusal_kind is not null"
SQL["refusals_by_kind"] = _with(_REQ) + """
select refusal_kind, count(*) as refusals from p where refusal_kind is not null group by 1
"""
SQL["request_messages"] = _with(_REQ) + """
select request_id, 0 as pos, role, md5(text) as text_md5 from p
where refusal_kind is null and role in ('user', 'assistant')
"""
SQL["mixed_messages"] = """
select doc_id as request_id, 0 as pos, 0 as part, 'user' as role, md5(text) as text_md5
from documents where doc_id % 6 in (0, 1, 5) and text is not null
union all select doc_id, 0, 3, 'user', md5('[tail]') from documents where doc_id % 6 = 1 and text is not null
union all select doc_id, 0, 4, 'user', md5('') from documents where doc_id % 6 = 1 and text is not null
"""
SQL["scan_text"] = _with(_REQ) + """
select request_id, md5(text) as scan_md5 from p where refusal_kind is null
"""

SQL["reply_problems"] = """
select o_orderkey as request_id,
  case when o_orderkey % 11 = 0 then 'upstream_redirect' when o_orderkey % 13 = 0 then 'upstream_content_type_invalid'
    when o_orderkey % 7 = 3 then 'upstream_decode_error'
    when o_orderkey % 7 in (1, 2, 4) then 'upstream_protocol_violation' end as problem,
  case when o_orderkey % 7 in (0, 5, 6) then o_orderkey::varchar end as content from orders
"""

SQL["frame_events"] = """
select event_id % 50 as request_id, event_id // 50 as event_idx, false as malformed,
  event_id::varchar as content from events
"""

SQL["event_strings"] = """
select event_id, case when event_id % 9 = 0 then '' else event_type || '|' || user_id::varchar end as strings,
  case when event_id % 9 = 0 then 'bad event.object' end as abort from events
"""

SQL["sibling_inspection"] = """
select event_id, case when event_id % 31 = 0 or event_id % 7 = 2 then 'block' else 'allow' end as decision,
  case when event_id % 31 = 0 or event_id % 7 = 2 then 'true' end as smuggled from events
"""

SQL["realtime_tool_calls"] = """
select 'c' || l_orderkey::varchar || '-' || l_linenumber::varchar as call_id,
  case when l_partkey % 5 = 0 then '<unknown>' else l_partkey::varchar end as tool_name,
  case when l_partkey % 3 = 0 then '{"q":1}' else '{"_raw":[7]}' end as arguments
from lineitem where l_linenumber % 2 = 1
"""

_PIPE = """
g as (select c.*, cu.c_mktsegment as segment,
  case when k = 3 then 'owner_resolution' when needs is null or holds is null or holds < needs
    then 'classification_gate' end as early from c join customer cu on cu.c_custkey = c.request_id),
n as (select request_id, row_number() over (partition by segment order by request_id) as rn from g where early is null),
v as (select g.*, coalesce(early, case when n.rn > 20 then 'segment_quota' end) as fired
  from g left join n on n.request_id = g.request_id)
"""

SQL["admission_pipeline"] = _with(_HEADERS, _PIPE) + f"""
select request_id, case when fired is null then 'allow' else 'block' end as decision, fired,
  case when fired is null then 'admission cleared' when fired = 'owner_resolution' then 'no commit owner could be resolved'
    when fired = 'segment_quota' then 'quota used up'
    when needs is null then 'unrecognized classification header value: ''' || needs_raw || ''''
    when holds is null then 'unrecognized clearance header value: ''' || holds_raw || ''''
    else 'caller clearance ' || {_NAMES}[holds + 1] || ' insufficient for data classification ' || {_NAMES}[needs + 1]
  end as reason from v
"""

SQL["pipeline_decisions"] = _with(_HEADERS, _PIPE) + """
select 'pipeline.admission' as check_name, case when fired is null then 'allow' else 'block' end as decision,
  case k when 0 then 'human' when 1 then 'agent' when 2 then 'policy' else 'unresolved' end as owner_type,
  count(*) as rows, count(fired) as shadowed from v group by 1, 2, 3
"""

SQL["receipt_verify"] = """
select 'e' || event_id::varchar as entry_id, event_id % 7 in (0, 3, 6) as valid,
  case event_id % 7 when 1 then 'bad_signature' when 2 then 'unknown_key' when 4 then 'bad_algorithm'
    when 5 then 'bad_header' end as problem from events
"""

SQL["archive_header"] = """
with recursive d as (select event_id as i, ts from events where ts < timestamp '2024-01-11'),
t as (select list(sha256(sha256(i::varchar)) order by i) as hs from d
  union all
  select list_transform(range(0, len(hs), 2),
    lambda i: sha256(unhex(hs[i + 1]) || unhex(hs[least(i + 2, len(hs))])))
  from t where len(hs) > 1)
select 1 as archive_format_version, count(*) as entry_count,
  strftime(min_by(ts, i), '%Y-%m-%dT%H:%M:%S.%fZ') as range_start,
  strftime(max_by(ts, i), '%Y-%m-%dT%H:%M:%S.%fZ') as range_end,
  (select hs[1] from t where len(hs) = 1) as merkle_root from d
"""

SQL["stream_token_bucket"] = SQL["token_bucket"]

SQL["stream_inspection"] = _with(_DRIFT, """
x as (select request_id, min(chunk_idx) as abort_chunk from s where kind is not null group by 1)
""") + """
select s.request_id, chunk_idx, case when chunk_idx > abort_chunk then 'dropped'
    when chunk_idx = abort_chunk then 'block' else 'allow' end as decision,
  case when chunk_idx = abort_chunk then kind end as kind
from s left join x on x.request_id = s.request_id
"""

SQL["stream_decision_rates"] = """
select epoch(date_trunc('day', ts))::bigint as start_s,
  case event_id % 5 when 0 then 'owner_resolution' when 1 then 'prompt_injection'
    when 2 then 'classification_gate' when 3 then 'rate_limit' else 'regex_content' end as check_name,
  event_type as decision, count(*) as decisions from events
where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from events)
group by 1, 2, 3
"""

SQL["stream_chain_links"] = """
select 'u' || user_id::varchar as chain_id, event_id as seq,
  coalesce(lag(event_type) over (partition by user_id order by event_id), '') = '' as link_ok from events
"""
