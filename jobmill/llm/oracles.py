"""DuckDB SQL for the queries that SQL can express on whole tables."""

#: CRC-32 of UTF-8 text: the table of the reflected polynomial, then one step per byte.
_CRC_STEP = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
_CRC = f"""
crc_0 as (select range as b, range as c from range(256)),
{", ".join(f"crc_{i + 1} as (select b, {_CRC_STEP} as c from crc_{i})" for i in range(8))},
crc_table as (select list(c order by b) as t from crc_8),
crc as (
  select txt, xor(list_reduce(
    list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(txt)), '..'), lambda h: ('0x' || h)::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as crc
  from (select distinct coalesce(text, '') as txt from documents), crc_table
)"""

_U = "((('0x' || substr(md5(k || '|' || i), 1, 13))::bigint + 0.5) / 4503599627370496.0)"

OP2 = f"""
with {_CRC.strip()},
keyed as (select doc_id, text, coalesce(doc_id::varchar, chr(0) || 'null') as k from documents),
scored as (
  select doc_id, k, coalesce(strlen(text), 0) + 1 as size, crc.crc as text_crc32,
         list_transform(range(0, 9), lambda i: -1.0 / ln({_U})) as s
  from keyed join crc on crc.txt = coalesce(text, '')
),
placed as (
  select *, list_position(s[1:8], list_max(s[1:8])) - 1 as shard, list_position(s, list_max(s)) - 1 as grown_shard from scored
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
       row_number() over (partition by shard order by md5(k), doc_id, text_crc32, size) - 1 as slot,
       grown_shard::int as grown_shard
from placed"""

OP4 = r"""
with base as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
),
classed as (
  select *, length(bin(size)) as bits from base
),
ranked as (
  select *, row_number() over (partition by source order by
      bits * 8 + case when bits > 3 then (size // (1::bigint << (bits - 4)::int)) % 8 else size end,
      md5(coalesce(doc_id::varchar, '')), doc_id, size) - 1 as place
  from classed
),
sizes as (select source, sum(size)::bigint as source_size from base group by source),
weighed as (
  select *, [5, 2, 1][(row_number() over (order by source is null, source) - 1) % 3 + 1] as w from sizes
),
filled as (
  select *, sum(source_size) over ()::double as total, sum(w) over ()::double as all_w,
    coalesce(sum(source_size) over (order by source_size / w, source is null, source rows between unbounded preceding and 1 preceding), 0)::double * 3.0 as fullness,
    coalesce(sum(w) over (order by source_size / w, source is null, source rows between unbounded preceding and 1 preceding), 0)::double as full_w
  from weighed
),
capped as (select *, source_size * 3.0::double * (all_w - full_w) <= w * (total - fullness) as is_capped from filled),
left_over as (
  select *, total - coalesce(sum(source_size) filter (is_capped) over (), 0)::double * 3.0::double as rest,
    coalesce(sum(w) filter (not is_capped) over (), 0)::double as rest_w from capped
),
rates as (
  select source, source_size, case when is_capped then source_size * 3.0::double else w * rest / rest_w end as target,
    ('0x' || substr(md5('mix|' || coalesce('s' || source, '')), 1, 5))::bigint / 1048576.0::double as offs
  from left_over
),
joined as (
  select doc_id, size, source_size, target, place, offs,
    least(case when source_size > 0 then target / source_size else 0 end, 3.0::double) as rate
  from ranked join rates on ranked.source is not distinct from rates.source
)
select doc_id, size, source_size, target::double as target,
  ((floor((place + 1) * rate + offs) - floor(place * rate + offs)) * size)::bigint as taken
from joined"""

OP7 = r"""
with n as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
),
r as (
  select doc_id, norm, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
    row_number() over w = 1 as kept
  from n window w as (partition by norm order by length(t) desc, doc_id)
)
select doc_id, keep_id, group_size, kept, sha256(norm) as text_sha256 from r"""

OP3 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as g from w
),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (
  select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)
),
reach as (select doc_id as d, doc_id as c from w union select link.b, reach.c from reach join link on link.a = reach.d)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(c) from reach where d = w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id"""

OP6 = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
),
ok as (
  select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
  where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0
),
link as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
),
reach as (select vec_id as d, vec_id as c from v union select link.b, reach.c from reach join link on link.a = reach.d)
select v.vec_id, (select count(*) from link where a = v.vec_id) as n_links,
  (select min(c) from reach where d = v.vec_id) as component_id,
  (select min(c) from reach where d = v.vec_id) = v.vec_id as kept
from v"""

OP8 = r"""
with c as (
  select conv_id, turn, text, case when role = 'user' then 'ask' else 'configure' end as name,
    'call-' || conv_id || '-' || turn as call_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
  from conversations where role in ('user', 'system')
),
edge as (select c.conv_id, c.turn, p.turn as prev from c join c p on p.conv_id = c.conv_id and p.turn in (c.turn - 1, c.turn - 2)),
lv as (
  with recursive walk as (
    select conv_id, turn, 0 as level from c
    union all
    select e.conv_id, e.turn, walk.level + 1 from walk join edge e on e.conv_id = walk.conv_id and e.prev = walk.turn
  )
  select conv_id, turn, max(level) as level from walk group by 1, 2
),
r as (select conv_id, turn, text as content, 'call-' || conv_id || '-' || (turn - 1) as call_id from conversations where role = 'assistant'),
j as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, c.turn, c.name, c.text, c.words, r.content,
    c.call_id is not null as is_call, r.call_id is not null as has_result
  from c full join r on c.conv_id = r.conv_id and c.call_id = r.call_id
)
select j.conv_id, j.call_id, lv.level::int as level,
  case when is_call then row_number() over (partition by is_call, j.conv_id order by lv.level, j.turn) - 1 end as position,
  j.name, case when not is_call then 'orphan' when has_result then 'linked' else 'unanswered' end as status,
  case when is_call then case when name = 'ask' then length(text) >= 1 and words >= 2 else words <= 40 end end as valid,
  case when is_call then
    case when name = 'ask' and length(text) < 1 then '.text: length out of range'
         when name = 'ask' and words < 2 then '.words: below minimum'
         when name = 'configure' and words > 40 then '.words: above maximum' end end as error,
  is_call::bigint as n_calls, has_result::bigint as n_results,
  case when is_call then '{"after":["call-' || j.conv_id || '-' || (j.turn - 2) || '","call-' || j.conv_id || '-' || (j.turn - 1) ||
    '"],"arguments":{"text":' || to_json(text)::varchar || ',"words":' || words || '},"id":"' || j.call_id || '","name":"' || name ||
    '","result":' || coalesce(to_json(content)::varchar, 'null') || '}' end as record
from j left join lv on lv.conv_id = j.conv_id and lv.turn = j.turn"""

OP12 = """
with rows as (
  select row_number() over () as rid, vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::varchar as lab,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select a.rid as a, a.vec_id as anchor_id, b.rid as b, b.vec_id, a.lab = b.lab as same, list_dot_product(a.v, b.v)::bigint as score
  from rows a join rows b on a.rid <> b.rid and len(a.v) = len(b.v) where a.vec_id % 100 = 0
),
positive as (
  select a, anchor_id, b, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by a order by score desc, vec_id nulls last) <= 5
)
select p.anchor_id, p.positive_id, (row_number() over w)::int as rank, s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positive p join scored s on s.a = p.a and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
window w as (partition by p.a, p.b order by s.score desc, s.vec_id nulls last)
qualify row_number() over w <= 5"""

_RUN = r"[A-Za-z\u00C0-\u00FF]+".encode().decode("unicode_escape")

#: Words one edit apart share what a deletion leaves: a replacement at the same place, an insertion the shorter word.
OP13 = f"""
with recursive {_CRC.strip().replace("select distinct coalesce(text, '') as txt from documents", "select distinct doc || ':' || run as txt from runs").replace("crc_0 as", "runs as (select doc, run, count(*) as n from (select coalesce(doc_id::varchar, '') as doc, translate(unnest(regexp_extract_all(text, '" + _RUN + "')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents) where length(run) >= 7 group by all), crc_0 as", 1)},
words as (
  select word, sum(n)::bigint as n from (
    select n, case when crc % 31 = 0 then substr(run, 1, (crc % length(run))::int) || substr(run, (crc % length(run))::int + 2) else run end as word
    from runs join crc on crc.txt = doc || ':' || run)
  where length(word) >= 7 group by word having sum(n) >= 2
),
cuts as (select word, n, place, substr(word, 1, (place - 1)::int) || substr(word, (place + 1)::int) as rest from (select word, n, unnest(range(1, length(word) + 1)) as place from words)),
near as (
  select distinct a.word, b.word as other, b.n from cuts a join cuts b on a.rest = b.rest and a.place = b.place and a.word <> b.word
  union select b.word, a.word, a.n from words a join cuts b on a.word = b.rest
  union select a.word, b.word, b.n from words a join cuts b on a.word = b.rest
),
best as (select word, count(*) as n_near, first(struct_pack(form := other, n := n) order by n desc, other) as b from near group by word),
formed as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when b.n >= 10 * w.n then b.form end as form, case when b.n >= 10 * w.n then b.n end as form_n
  from words w left join best using (word)
),
path as (
  select word, word as root, 0 as hops from formed
  union all select p.word, f.form, p.hops + 1 from path p join formed f on f.word = p.root where f.form is not null
)
select f.word, f.form, p.root, f.n, f.n_near, f.form_n
from formed f join (select word, first(root order by hops desc) as root from path group by word) p using (word)"""
