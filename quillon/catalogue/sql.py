"""The same queries in SQL, over the same tables."""

from __future__ import annotations

from .standins import EVENT_WINDOW, PERMUTATION_PART, SUBJECT_WINDOW, SUBMISSION

TABLES = f"""
with attribution_submission as (select o_orderkey id, o_orderkey submission_id, o_custkey subject, o_orderpriority "version", epoch_us(o_orderdate) // 1000000 created_at from orders),
submission as (select o_orderkey id, epoch_us(o_orderdate) // 1000000 created_at, sha256(o_orderkey::varchar) hash, case when o_orderstatus <> 'O' then epoch_us(o_orderdate) // 1000000 + 60 end completed_at from orders),
device as (select p_partkey id, p_brand integration, p_type manufacturer, nullif(p_name, 'red plate') model, p_size::varchar model_id from part),
attribution_device as (select distinct l_orderkey submission_id, l_partkey device_id from lineitem),
permutation as (select distinct l_partkey || '-' || l_suppkey || '-' || l_linenumber id, l_partkey device_id, case when l_suppkey % 2 = 0 then 'service' end entry_type, l_linenumber % 2 = 0 has_configuration_url,
  '"' || l_linenumber || '"' version_sw, case when l_suppkey % 3 = 1 then 'None' when l_suppkey % 3 = 2 then '"h' || (l_suppkey % 7) || '"' end version_hw from lineitem),
attribution_permutation as (select distinct l_orderkey submission_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber permutation_id from lineitem),
entity as (select distinct l_returnflag || l_linestatus id, l_linestatus "domain", false assumed_state, true has_name, null::varchar category, l_returnflag original_device_class, null::varchar unit_of_measurement from lineitem),
sets as (select l_orderkey, l_linenumber, l_partkey || '-' || l_suppkey || '-' || l_linenumber permutation_id, l_returnflag || l_linestatus entity_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber || '|' || l_returnflag || l_linestatus set_id from lineitem),
attribution_set as (select l_orderkey || '/' || l_linenumber id, l_orderkey submission_id, set_id from sets),
turns as (select conv_id, conv_id || ':' || (turn - 1) parent_id, conv_id || ':' || turn child_id from (select distinct conv_id, turn from conversations) c where exists (select 1 from conversations b where b.conv_id = c.conv_id and b.turn = c.turn - 1)),
clock as (select max(created_at) t from attribution_submission),
subjects as (select distinct subject from attribution_submission where created_at >= (select t from clock) - {SUBJECT_WINDOW}),
derived_subject as (select subject, count(*) - 1 streak from attribution_submission where subject in (select subject from subjects) group by subject having count(*) > 1),
attributed as (select distinct submission_id, subject from attribution_submission where subject in (select subject from derived_subject)),
filtered as (select * from device where integration not in ('Brand#1', 'Brand#7') and manufacturer is not null and trim(manufacturer, ' ') <> '' and lower(manufacturer) not in ('unknown', 'unknown manufacturer', 'undefined', '(unknown)', '?', '--')
  and manufacturer not ilike '_T%' and not ((model is null or trim(model, ' ') = '') and (model_id is null or trim(model_id, ' ') = '')) and model not ilike '% ring'),
counted as (select device_id, count(distinct subject) "count" from attributed join attribution_device using (submission_id) where device_id in (select id from filtered) group by 1 having count(distinct subject) >= 10),
latest as (select subject, (array_agg(submission_id order by created_at desc, submission_id desc))[1] submission_id from attribution_submission group by 1),
popularity as (select submission_id, count(*) "count" from latest where subject in (select subject from derived_subject) group by 1),
active as (select permutation_id, sum("count")::bigint "count" from popularity join attribution_permutation using (submission_id) group by 1),
dated as (select id submission_id, created_at from submission where completed_at is not null and id in (select submission_id from attributed)),
first_seen as (select device_id, min(created_at) first_encountered_at from attribution_device join dated using (submission_id) where device_id in (select device_id from counted) group by 1),
permutation_seen as (select permutation_id id, min(created_at) seen_at from attribution_permutation join dated using (submission_id) group by 1),
software as (select device_id, case when version_sw like '"%"' then substr(version_sw, 2, length(version_sw) - 2) else version_sw end "version", sum(a."count")::bigint active, min(seen_at) first_encountered_at
  from permutation p left join active a on a.permutation_id = p.id left join permutation_seen s on s.id = p.id where version_sw is not null and trim(version_sw, ' ') <> '' and version_sw not in ('""', '"None"', '"0"') group by 1, 2
  having sum(a."count") is not null and min(seen_at) is not null),
hardware as (select device_id, case when version_hw like '"%"' then substr(version_hw, 2, length(version_hw) - 2) else version_hw end "version", min(seen_at) first_encountered_at
  from permutation p left join permutation_seen s on s.id = p.id where version_hw is not null and trim(version_hw, ' ') <> '' and version_hw not in ('""', '"None"', '"0"') group by 1, 2 having min(seen_at) is not null),
shown as (select distinct split_part(set_id, '-', 1)::bigint device_id, "domain", case when original_device_class in ('A', 'N') then original_device_class end original_device_class
  from sets join entity on entity.id = entity_id where l_orderkey in (select submission_id from attributed)),
plain as (select device.*, c."count" from device join (select device_id, count(*) "count" from attribution_device group by 1) c on c.device_id = device.id),
found as (select * from plain where (manufacturer ilike '%e%' or model ilike '%e%' or model_id ilike '%e%') and manufacturer not in ('PROMO') and integration in (select 'Brand#' || i from range(1, 20) r(i)) and integration not in ('Brand#3')),
some_permutation as (select min(id) id from permutation where device_id = {PERMUTATION_PART}),
events_ as (select event_id id, user_id subject, epoch_us(ts) // 1000000 created_at from events),
event_subjects as (select distinct subject from events_ where created_at >= (select max(created_at) from events_) - {EVENT_WINDOW}),
tree as (select n_name ancestor, n_name descendant from nation union all select r_name, r_name from region union all select r_name, n_name from nation join region on n_regionkey = r_regionkey)
"""



def _pad(byte: int, key: bytes = b"key") -> str:
    return bytes(b ^ byte for b in key.ljust(64, b"\0")).hex()


_COUNT = 'select count(*) "count" from {}'
_LIMBS = ", ".join(f"sum(('0x' || substr(digest, {8 * i + 1}, 8))::bigint)::bigint limb{i}" for i in range(8))

_QUERIES = {
    "subject_streak": "select subject, count(*) - 1 streak from events_ where subject in (select subject from event_subjects) group by 1 having count(*) > 1",
    "subject_streak_bounded": "select subject, count(*) streak from (select subject, created_at, lag(created_at) over (partition by subject order by created_at) p from events_ where subject in (select subject from events_ where created_at >= (select max(created_at) from events_) - 90000)) where created_at - p <= 3600 group by 1",
    "submission_faulty": """select 'unfinished' state, count(*) "count" from submission where completed_at is null and created_at < (select t from clock) - 7200 group by 1
      union all select 'empty', count(*) from submission where id not in (select submission_id from attribution_device) group by 1
      union all select 'unreferenced', count(*) from submission where id not in (select submission_id from attribution_submission) group by 1""",
    "device_filtered": "select * from filtered",
    "device_counted": "select * from counted",
    "latest_submission_popularity": "select * from popularity",
    "active_permutation": "select * from active",
    "first_encountered": "select * from first_seen",
    "versions_software": "select * from software",
    "versions_hardware": "select * from hardware",
    "device_entities": "select * from shown",
    "derived_device": """select c.device_id id, integration, manufacturer, model, model_id, first_encountered_at,
      coalesce((select string_agg("version" || ':' || active || ':' || s.first_encountered_at, ',' order by "version" || ':' || active || ':' || s.first_encountered_at) from software s where s.device_id = c.device_id), '') versions_software,
      coalesce((select string_agg("version" || ':' || h.first_encountered_at, ',' order by "version" || ':' || h.first_encountered_at) from hardware h where h.device_id = c.device_id), '') versions_hardware,
      coalesce((select string_agg("domain" || ':' || coalesce(original_device_class, 'null'), ',' order by "domain" || ':' || coalesce(original_device_class, 'null')) from shown e where e.device_id = c.device_id), '') entities, c."count"
      from counted c join device d on d.id = c.device_id left join first_seen f on f.device_id = c.device_id""",
    "devices_search": 'select * from found order by "count" desc, id limit 50 offset 20',
    "devices_search_all": "select * from found",
    "device_by_id": f"select * from plain where id = {PERMUTATION_PART}",
    "devices_count": _COUNT.format("found"),
    "devices_facets": 'select manufacturer, integration, count(*) "count" from found group by 1, 2',
    "category_rollup": """select ancestor category, sum(n)::bigint "count" from (select c_nationkey k, count(*) n from customer group by 1) c
      join (select n_nationkey k, n_name from nation union all select n_nationkey + 1, n_name from nation) m using (k) join tree on descendant = n_name group by 1""",
    "dimension_facets": """, cust as (select c_nationkey k, count(*) n from customer group by 1)
      select 'manufacturer' facet, c_mktsegment "value", count(*) "count" from customer group by 2 union all select 'integration', k::varchar, n from cust
      union all select 'connectivity', case when k % 3 = 1 then 'online' else 'offline' end, sum(n)::bigint from cust where k % 3 <> 0 group by 2
      union all select 'category', ancestor, sum(n)::bigint from cust join nation on n_nationkey = k join tree on descendant = n_name group by 2""",
    "submissions_range": "select * from submission where created_at between (select t from clock) - 2592000 and (select t from clock) and completed_at is not null",
    "submissions_range_incomplete": "select * from submission where created_at between (select t from clock) - 2592000 and (select t from clock) and completed_at is null",
    "attributions_range": "select * from attribution_submission where created_at between (select t from clock) - 2592000 and (select t from clock)",
    "device_by_submission": f"select device.* from device join attribution_device on device_id = id where submission_id = {SUBMISSION}",
    "permutation_by_submission": f"select permutation.* from permutation join attribution_permutation on permutation_id = id where submission_id = {SUBMISSION}",
    "link_by_submission": "select parent_id || '-' || child_id id, parent_id, child_id from turns where conv_id = 1",
    "entity_by_submission_permutation": """select distinct entity.* from sets join entity on entity.id = entity_id where permutation_id = (select id from some_permutation)
      and l_orderkey = (select min(submission_id) from attribution_permutation where permutation_id = (select id from some_permutation))""",
    "entity_composition": """select set_id, count(distinct l_orderkey) "count", string_agg(distinct entity.id || ':' || "domain" || ':' || original_device_class, ',') entities
      from sets join entity on entity.id = entity_id where permutation_id = (select id from some_permutation) group by 1""",
    "submission_by_hash": "select * from submission where hash = '7902699be42c8a8e46fbbb4501726517e86b22c56a189f7625a6da49081b2451'",
    "attribution_by_subject": "select * from attribution_submission where subject = 7",
    "attribution_by_id": f"select * from attribution_submission where id = {SUBMISSION}",
    "count_submission": _COUNT.format("submission"),
    "count_attribution": _COUNT.format("attribution_submission"),
    "count_device": _COUNT.format("device"),
    "count_permutation": _COUNT.format("permutation"),
    "count_entity": _COUNT.format("entity"),
    "count_subject": _COUNT.format("(select distinct subject from attribution_submission)"),
    "count_integration": _COUNT.format("(select distinct integration from device)"),
    "manufacturer_integration_count": 'select manufacturer, integration, count(*) "count" from device group by 1, 2',
    "entity_domain_class_count": 'select "domain", original_device_class, count(*) "count" from entity group by 1, 2',
    "version_count": 'select "version", count(*) "count" from attribution_submission group by 1',
    "model_count": 'select model, count(*) "count" from device group by 1',
    "gauge_model": "select integration, coalesce(model, '<unknown>') model, count(*) \"count\" from device group by 1, 2",
    "dedup_upsert": "select distinct integration, manufacturer, case when id % 5 = 0 then '' else coalesce(model, '') end model, '' model_id from device",
    "content_ids": "select integration, manufacturer, model, sha256(concat_ws(chr(1), 'device', integration, manufacturer, coalesce(model, ''))) content_id from device",
    "set_identities": "select l_orderkey submission_id, to_base64(unhex(sha256(string_agg(entity_id, '' order by entity_id)))) hash from (select distinct l_orderkey, entity_id from sets) group by 1",
    "version0_hashes": """, ids as (select submission_id, 0 k, permutation_id id from attribution_permutation union all select conv_id, 1, parent_id || '-' || child_id from turns union all select submission_id, 2, set_id from attribution_set)
      select s.id submission_id, '0-' || to_base64(unhex(sha256(coalesce(string_agg(ids.id, '' order by k, ids.id), '')))) hash from submission s left join ids on ids.submission_id = s.id group by 1""",
    "legacy_entity_sets": """, pairs as (select l_orderkey, 'p-' || (l_orderkey % 50) permutation_id, entity_id from sets),
      m as (select l_orderkey, permutation_id, count(distinct entity_id) n, to_base64(unhex(sha256(string_agg(distinct entity_id, '' order by entity_id)))) hash from pairs group by 1, 2)
      select permutation_id, hash, n entities, count(*) uses from m group by 1, 2, 3""",
    "delete_cascade": """, gone as (select id from attribution_submission where "version" = '1-URGENT')
      select 'submission' "name", count(*) "count" from submission where id not in (select id from gone)
      union all select 'attribution_submission', count(*) from attribution_submission where submission_id not in (select id from gone)
      union all select 'attribution_device', count(*) from attribution_device where submission_id not in (select id from gone)
      union all select 'attribution_permutation', count(*) from attribution_permutation where submission_id not in (select id from gone)
      union all select 'attribution_set', count(*) from attribution_set where submission_id not in (select id from gone)
      union all select 'attribution_link', count(*) from turns where conv_id not in (select id from gone)""",
    "orphan_devices": f"""select id from device where id not in (select device_id from attribution_device
      where submission_id not in (select id from attribution_submission where created_at < (select t from clock) - {SUBJECT_WINDOW}))""",
    "late_window": "select id, subject, created_at + 82800 expected_at from attribution_submission where created_at + 82800 <= (select t from clock) - 86400 and (select t from clock) - 86400 <= created_at + 82800 + 864000",
    "finished_submissions": "select id, created_at, case when completed_at is null and id % 3 = 0 then 'h' else hash end hash, case when completed_at is null and id % 3 = 0 then created_at + 5 else completed_at end completed_at from submission",
    "swapped_columns": "select id, case when manufacturer like '%A%' then manufacturer else model end model, case when manufacturer like '%A%' then model else manufacturer end manufacturer from device",
    "limb_sums_by_subject": f"select subject, {_LIMBS} from (select subject, sha256(id::varchar) digest from attribution_submission) group by 1",
    "link_dangling": """select conv_id submission_id, turn::varchar child, 'c' parent_integration, case when turn % 2 = 0 then turn + 3 else -turn - 3 end parent_offset
      from (select distinct conv_id, turn, count(*) over (partition by conv_id) n from (select distinct conv_id, turn from conversations)) c
      where not exists (select 1 from conversations d where d.conv_id = c.conv_id and d.turn = case when c.turn % 2 = 0 then c.turn + 3 else n - c.turn - 3 end)""",
    "json_explode": "select event_id, unnest(json_keys(props)) \"key\", unnest(list_transform(json_keys(props), lambda k: (props->>k)::bigint)) \"value\" from events",
    "link_extract": "select distinct page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) reference from pages",
    "devices_search_special": """, odd as (select plain.* replace (case id % 4 when 0 then replace(model, ' ', '%') when 1 then replace(model, ' ', '_') when 2 then model || '\\%' else model end as model) from plain),
      terms as (select * from (values (0, '%|%%', '|'), (1, '%|_%', '|'), (2, '%|%', '|'), (3, '%a|%%', '|'), (4, '%b|_%', '|'), (5, '%as%', '|'), (6, '%\\%', '|')) v(term, pattern, escape))
      select term, id from odd, terms where lower(manufacturer) like pattern escape '|' or lower(model) like pattern escape '|' or lower(model_id) like pattern escape '|'""",
    "device_hash": """select id, sha256(concat(integration, coalesce(manufacturer, 'null'), coalesce(model, 'null'), coalesce(model_id, 'null'), 'service', case when id % 3 = 0 then 'true' else 'false' end, 'null', '1.0',
      case when encode(manufacturer) < encode(integration) then a || b else b || a end)) hash
      from (select *, manufacturer || 'nullnulltruefalsenull' a, integration || 'null' || model_id || case when id % 2 = 0 then 'true' else 'false' end || 'falsenull' b from device)""",
    "hash_texts": f"""select id, '1-' || to_base64(unhex(hash)) "text", hash, true "unknown", sha256(unhex('{_pad(0x5C)}' || sha256(unhex('{_pad(0x36)}') || encode(id::varchar)))) keyed from submission""",
    "reconstructed": """select l_orderkey submission_id, integration, manufacturer, model, split_part(permutation_id, '-', 3) sw_version,
      case when split_part(permutation_id, '-', 2)::int % 3 = 1 then 'None' when split_part(permutation_id, '-', 2)::int % 3 = 2 then 'h' || (split_part(permutation_id, '-', 2)::int % 7) end hw_version,
      "domain" || ':' || original_device_class entities from sets join device on device.id = split_part(permutation_id, '-', 1)::bigint join entity on entity.id = entity_id""",
    "repointed_links": "select distinct conv_id submission_id, '#' || parent_id || '-' || child_id link_id from turns",
    "once_each": """select id, created_at, o_orderkey from (select o_custkey id, epoch_us(o_orderdate) created_at, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) k from orders)
      where k = 1 and id not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""",
    "inserted_pairs": "select * from attribution_device",
    "arrivals": """select id, case when e is null or created_at between e and e + 2592000 then 'in_time' when created_at < e then 'too_early' else 'too_late' end arrival
      from (select id, created_at, lag(created_at) over (partition by subject order by created_at, id) + 82800 e from attribution_submission)""",
    "next_expected": "select subject, max(created_at) + 82800 expected_at from attribution_submission group by 1",
    "category_integrations": """, three as (select r_name from region order by r_name limit 3)
      select n_name integration from nation join region on n_regionkey = r_regionkey where r_name in (select r_name from three) and n_nationkey % 3 = 1""",
    "integration_manifest": """select c_custkey::varchar "name", c_name title, 'integrations/' || c_custkey url, case c_custkey % 5 when 0 then 'Light' when 1 then 'Car' when 3 then 'Media Player' else '' end categories,
      case c_custkey % 5 when 0 then 'lighting' when 1 then 'car' when 3 then 'entertainment' end classified, case when c_custkey % 5 in (0, 1, 3) then true end inferred,
      case c_custkey % 3 when 0 then 'offline' when 1 then 'online' end connectivity, 'https://a.b/' || c_custkey || ',https://c.d' "references" from customer""",
    "catalog_sizes": """select * from (values ('staging.attribution_device', true, true), ('staging.submission', true, true), ('staging.link', true, false)) v("name", whole, filled)""",
    "streaming_ingest": """, bodies as (select submission_id, list_sort(list(distinct (integration, manufacturer, coalesce(model, 'null'), model_id))) b from attribution_device join device on device.id = device_id group by 1),
      used as (select distinct integration, manufacturer, coalesce(model, '') model, model_id from device where id in (select device_id from attribution_device)),
      kept as (select b, min(created_at) from bodies join attribution_submission using (submission_id) group by 1)
      select 'device' "name", count(*) "count" from used union all select 'permutation', count(*) from used union all select 'submission', count(*) from kept
      union all select 'attribution_submission', count(*) from bodies union all select 'attribution_device', sum(len(b))::bigint from kept union all select 'entity', 0""",
    "latency_means": """, gaps as (select user_id "name", event_id "at", round((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1000000)::bigint "seconds" from events),
      m as (select *, avg("seconds") over (partition by "name" order by "at", "seconds" rows unbounded preceding) mean, avg("seconds") over (partition by "name" order by "at", "seconds" rows between unbounded preceding and 1 preceding) before from gaps where "seconds" is not null)
      select "name", "at", "seconds", round(mean, 3) mean, "seconds" > case when before is null then 10.0 else 2 * greatest(0.01, before) end slow from m""",
    "table_sizes": "select 'device' \"name\", count(*) pgsize from device union all select 'submission', count(*) from submission union all select 'entity', count(*) from entity",
    "health": "select 1::int one",
}
ORACLES = {name: TABLES + text for name, text in _QUERIES.items()}


def _carried() -> str:
    """The hexadecimal digits of the limbs' sum, without leading zeros."""
    total, digits = "limb7", []
    for i in range(7, -1, -1):
        digits.insert(0, f"lpad(printf('%x', ({total}) % 4294967296), 8, '0')")
        total = f"({total}) // 4294967296" + (f" + limb{i - 1}" if i else "")
    return "ltrim(printf('%x', " + total + ") || " + " || ".join(digits) + ", '0')"


ORACLES["commutative_hash_by_subject"] = f"""{TABLES}, limbs as ({_QUERIES["limb_sums_by_subject"]}), digits as (select subject, {_carried()} h from limbs)
select subject, sha256(unhex(case when h = '' then '00' when length(h) % 2 = 1 then '0' || h else h end)) hash from digits"""

_CYCLES = """
with recursive c as (select distinct conv_id, turn, role from conversations),
edges as (select distinct c.conv_id submission_id, c.conv_id || ':' || c.turn child, d.conv_id || ':' || d.turn parent from c join c d on d.conv_id = c.conv_id and (d.turn = c.turn - 1 or d.turn = c.turn + 2 and c.role = 'user')),
reach as (select * from edges union select r.submission_id, r.child, e.parent from reach r join edges e on e.submission_id = r.submission_id and e.child = r.parent)
"""
ORACLES["link_cycles"] = _CYCLES + "select submission_id, child node from reach where child = parent"
ORACLES["link_uncircular"] = _CYCLES + "select * from edges where (submission_id, child) not in (select (submission_id, child) from reach where child = parent)"
ORACLES["classify_integration"] = """
with s as (select c_nationkey, c_custkey % 40 k, list(distinct case c_mktsegment when 'BUILDING' then 'Light' when 'AUTOMOBILE' then 'Car' when 'HOUSEHOLD' then 'Media Player' when 'FURNITURE' then 'Remote' end) c from customer group by 1, 2),
f as (select c_nationkey, k, list_sort(list_filter(c, lambda x: x is not null)) c from s)
select c_nationkey, k, array_to_string(c, ',') categories, case when c = ['Light'] then 'lighting' when c = ['Car'] then 'car' when c = ['Media Player'] or c = ['Media Player', 'Remote'] then 'entertainment' end classified from f
"""
