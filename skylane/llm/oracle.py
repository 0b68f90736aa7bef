"""DuckDB SQL of the corpus operators that SQL can express, written from their contracts."""

from __future__ import annotations

OP5 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, length(role) + length(text) + 9 + 1 + 7 + 1
    + len(regexp_extract_all(text, '<\\*\|start\|>|<\\*\|end\|>|<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|<\\*s>|<\\*/s>')) as n,
    row_number() over (partition by conv_id order by turn, role, text) as k,
    count(*) over (partition by conv_id) as last
  from turns),
grown as (select *, sum(n) over (partition by conv_id order by k) as upto from sized)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  coalesce(sum(upto) filter (role = 'assistant' or k = last), 0)::bigint as formatted_chars,
  count(*) filter (role = 'assistant' or k = last)::bigint as n_examples
from grown group by conv_id
"""

OP6 = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, source from documents),
w as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
grams as (
  select r, i, array_to_string(words[i:i + 4], ' ') as g from w, unnest(range(1, len(words) - 3)) as u(i) where len(words) >= 5),
twice as (select r, i from grams qualify count(*) over (partition by r, g) > 1),
covered as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from twice) group by r),
lines as (select r, unnest(string_split(text, chr(10))) as line from d),
worded as (
  select r, line, translate(regexp_replace(lower(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))),
    '[\x20\x09-\x0D]+', ' ', 'g'), '123456789', '000000000') as plain,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
per_doc as (select r, count(*) - count(distinct line) as dup from worded group by r),
contents as (select min(r) as r, source, text from d group by source, text),
frequent as (
  select c.source, plain from worded join contents c using (r) group by c.source, plain
  having count(distinct r) > 20),
gone as (
  select x.r, sum(n) as n from worded x join d using (r) join frequent f on f.plain = x.plain and f.source is not distinct from d.source
  group by x.r),
base as (
  select d.r, doc_id, len(words)::bigint as n_words, coalesce(list_sum([length(x) for x in words]), 0)::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols, coalesce(dup, 0)::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as removed_words
  from d join w using (r) left join per_doc using (r) left join covered using (r) left join gone using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
    and not (removed_words > 0 and (n_words - removed_words < 10 or n_words - removed_words < 0.3 * n_words)) as kept
from base
"""

OP8 = """
with coded as (select vec_id, [x > 0 for x in embedding] as bits from embeddings where vec_id is not null and embedding is not null),
pairs as (
  select q.vec_id as query_id, e.vec_id as neighbour_id,
    list_sum([(z[1] <> z[2])::int for z in list_zip(q.bits, e.bits)])::int as distance
  from coded q, coded e where q.vec_id % 20 = 0 and e.vec_id <> q.vec_id)
select query_id, (row_number() over (partition by query_id order by distance, neighbour_id))::int as rank, neighbour_id, distance
from pairs qualify row_number() over (partition by query_id order by distance, neighbour_id) <= 10
"""

OP9 = r"""
with recursive d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
shingles as (
  select distinct r, array_to_string(words[i:i + 3], ' ') as s from d, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as u(i) where len(words) > 0),
sizes as (select r, count(*) as n from shingles group by r),
shared as (select a.r as a, b.r as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.r < b.r group by a.r, b.r),
links as (
  select a, b from shared join sizes x on x.r = a join sizes y on y.r = b where 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
pairs as (select a, b from links union select b, a from links),
reach(r, t) as (select r, r from d union select reach.r, pairs.b from reach join pairs on pairs.a = reach.t)
select d.doc_id, coalesce(sizes.n, 0)::bigint as n_shingles, min(e.doc_id) as component_id
from d left join sizes on sizes.r = d.r join reach on reach.r = d.r join d e on e.r = reach.t
group by d.r, d.doc_id, sizes.n
"""

#: CRC-32 as sums (xor) of what each byte adds at its distance from the end, from a table that SQL builds.
OP13 = r"""
with recursive bits as (
  select b, b::bigint as c, 0 as k from range(256) r(b)
  union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), step as (select b, c from bits where k = 8),
texts as (
  select row_number() over () as row, doc_id, true as own, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all select -row_number() over (), null, false, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), placed as (select row, doc_id, own, coalesce(w, []) as w from texts),
spans as (
  select row, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from placed
), counted as (select row, own, f, count(*) as n from spans group by all),
feature as (select f, hex(encode(f)) as h, octet_length(encode(f)) as size from (select distinct f from counted)),
part as (
  select 0 as k, b, c from step
  union all select k + 1, part.b, xor(part.c >> 8, step.c) from part join step on step.b = part.c & 255 where k < (select max(size) from feature)
), start as (
  select 0 as k, 4294967295 as z
  union all select k + 1, xor(z >> 8, step.c) from start join step on step.b = z & 255 where k < (select max(size) from feature)
), byte as (select f, size, unnest(range(size)) as i, h from feature),
crc as (
  select f, size, bit_xor(part.c) as x from byte join part on part.k = size - 1 - i and part.b = ('0x' || substr(h, 2 * i + 1, 2))::int group by f, size
), bucket as (select f, xor(xor(x, z), 4294967295) % 10000 as b from crc join start on k = size),
held as (select row, own, b, sum(n)::bigint as n from counted join bucket using (f) group by all),
total as (select b, coalesce(sum(n) filter (own), 0)::double as s, coalesce(sum(n) filter (not own), 0)::double as t from held group by b),
whole as (select sum(s) as s, sum(t) as t from total),
gain as (select b, floor(1000 * ln((total.t + 1) * (whole.s + 10000) / ((total.s + 1) * (whole.t + 10000))))::bigint as g from total, whole),
weight as (select row, sum(n)::bigint as n, floor(sum(n * g)::double / sum(n))::bigint as weight from held join gain using (b) where own group by row),
scored as (
  select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, len(w)::bigint as n_words, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from placed left join weight using (row) where own
), able as (
  select *, row_number() over (order by score desc, doc_id nulls last, n_features, weight, n_words) as place, count(*) over () as of from scored where n_words >= 20
)
select doc_id, n_features, weight, score, case when place <= 25 * of // 100 then place end as rank, n_words from able
union all select doc_id, n_features, weight, score, null, n_words from scored where n_words < 20
"""

ORACLE = {"op5_chat": OP5, "op6_quality": OP6, "op8_search": OP8, "op9_jaccard": OP9, "op13_importance_resampling": OP13}
