"""DuckDB pieces that several oracles share."""

SID = "case when turn % 2 = 0 then 'c' || conv_id || '-m' || turn end"

#: The capture log, with x as its rows.
LOG = f"""
base as (select *, {SID} as sid from conversations),
log0 as (
  select conv_id, turn, role, 0 as rank, text, turn as seq, sid as source_id, 'partial' as status, '-6' as suffix from base where role = 'assistant' and (conv_id + turn) % 9 = 0
  union all select conv_id, turn, role, 1, substr(text, 1, length(text) // 2), turn, sid, 'partial', '-3' from base where role = 'assistant' and (conv_id + turn) % 7 = 0
  union all select conv_id, turn, role, 2, text, turn, sid, 'complete', '-0' from base
  union all select conv_id, turn, role, 3, text, turn + 2, null, 'complete', '-1' from base where conv_id % 3 = 0
  union all select conv_id, turn, role, 4, text || ' (edited)', turn, sid, 'complete', '-2' from base where conv_id % 5 = 0 and role = 'user' and turn % 2 = 0
  union all select conv_id, turn, role, 5, text, turn, sid, 'complete', '-0' from base where conv_id % 4 = 0
  union all select conv_id, turn, role, 6, text, turn, sid, 'complete', '-5' from base where conv_id % 11 = 0 and turn = 0),
log as (select *, 'capture:' || conv_id || '-' || turn || suffix as key, cast(rank as bigint) * 1000000000 + conv_id * 1000 + turn as arrival,
  sha256(case when rank = 6 then text || 'x' else text end) as declared,
  sha256(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) as digest from log0),
checked as (select *, case when not regexp_matches(key, '^[A-Za-z0-9._:-]{{8,128}}$') then 'bad_key'
  when role not in ('user', 'assistant', 'tool', 'system') then 'bad_role' when length(text) > 1000000 then 'too_long'
  when role = 'user' and status = 'partial' then 'partial_user'
  when sha256(text) <> declared then 'checksum_mismatch' end as reject_reason from log),
outcomes as (select *, case when reject_reason is not null then 'rejected'
  when row_number() over (partition by key, reject_reason is null order by arrival) > 1 then 'replayed' else 'admitted' end as outcome from checked),
admitted as (select * from outcomes where outcome = 'admitted'),
contents as (select conv_id, turn, role, digest, min(arrival) as first_arrival, max(arrival) as last_arrival, arg_min(status, arrival) as first_status,
  bool_or(status = 'complete') as completed, arg_min(text, arrival) as text, arg_min(seq, arrival) as seq from admitted group by all),
versions as (select *, cast(row_number() over (partition by conv_id, turn order by first_arrival) as int) as version_number from contents)
"""

#: Admitted captures with their messages: a recursion over the n-th capture of every conversation, whose messages it carries as a list.
RESOLVED = f"""with recursive {LOG},
caps as (select conv_id, role, source_id, cast(seq as bigint) as seq, status, arrival, digest, cast(length(text) as bigint) as char_count, row_number() over (partition by conv_id order by arrival) as n,
  sha256(conv_id || '|' || lower(role) || '|' || digest || '|' || cast(floor(seq / 5) as bigint) || '|0') as print from admitted),
fold as (
  select conv_id, cast(0 as bigint) as n, cast([] as struct(message bigint, role varchar, source varchar, print varchar, seq bigint, digests varchar[], states varchar[])[]) as msgs,
    cast(null as bigint) as message, '' as layer, 0 as version_number, '' as outcome from (select distinct conv_id from caps)
  union all
  select conv_id, n, case when layer = 'none' then list_append(msgs, {{'message': arrival, 'role': role, 'source': source_id, 'print': print, 'seq': seq, 'digests': [digest], 'states': [status]}})
    else list_transform(msgs, lambda m: case when m.message <> message then m else {{'message': m.message, 'role': m.role, 'source': coalesce(m.source, source_id), 'print': m.print, 'seq': seq,
      'digests': case when outcome = 'new' then list_append(m.digests, digest) else m.digests end,
      'states': case when outcome = 'new' then list_append(m.states, status) when outcome = 'reconciled' then list_transform(m.states, lambda x, i: case when i = version_number then 'reconciled' else x end) else m.states end}} end) end,
    message, layer, version_number, outcome
  from (select *, case when had is null then coalesce(len(own.digests), 0) + 1 else had end as version_number,
      case when had is null then 'new' when own.states[had] = 'partial' and status = 'complete' then 'reconciled' else 'identical' end as outcome
    from (select *, nullif(list_position(own.digests, digest), 0) as had
      from (select *, list_filter(msgs, lambda m: m.message = message)[1] as own
        from (select *, coalesce(by_source, by_print, by_content, arrival) as message,
            case when by_source is not null then 'source' when by_print is not null then 'fingerprint' when by_content is not null then 'content' else 'none' end as layer
          from (select c.*, f.msgs, list_filter(f.msgs, lambda m: m.source = c.source_id)[1].message as by_source, list_filter(f.msgs, lambda m: m.print = c.print)[1].message as by_print,
              list_sort(list_transform(list_filter(f.msgs, lambda m: m.role = c.role and list_contains(m.digests, c.digest)), lambda m: {{'seq': m.seq, 'message': m.message}}))[1].message as by_content
            from fold f join caps c on c.conv_id = f.conv_id and c.n = f.n + 1)))))),
resolved as (select caps.*, message, layer, cast(version_number as int) as version_number, outcome from fold join caps using (conv_id, n)),
numbered as (select conv_id, message, version_number, min(role) as role, min(digest) as digest, min(arrival) as first_arrival, count(*) as captures, arg_min(char_count, arrival) as char_count,
  case when bool_or(outcome = 'reconciled') then 'reconciled' else arg_min(status, arrival) end as version_status from resolved group by all),
messages as (select r.conv_id, r.message, min(role) as role, arg_min(source_id, arrival) filter (source_id is not null) as source_id, arg_max(seq, arrival) as seq, max(version_number) as versions,
 arg_max(digest, version_number) filter (outcome = 'new') as current_digest, coalesce(max(version_number) filter (outcome = 'reconciled' or (outcome = 'new' and status = 'complete')), 0) as latest_complete,
 case when bool_or(outcome = 'reconciled' or (outcome = 'new' and status = 'complete')) then 'complete' else arg_max(status, arrival) filter (outcome = 'new') end as status,
 cast(count(*) as int) as captures, cast(count(*) filter (outcome = 'identical') as int) as identical, cast(count(*) filter (outcome = 'reconciled') as int) as reconciled
 from resolved r group by r.conv_id, r.message)
"""

#: The first eight hexadecimal digits of a sha256 as a number.
BUCKET = "cast(('0x' || substr(sha256({0}), 1, 8)) as bigint)"

#: Epoch seconds of a time without a zone.
EPOCH = "cast(floor(epoch({0})) as bigint)"
