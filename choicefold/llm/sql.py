"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from . import mixing

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""
with d as (select doc_id, source, len({WORDS})::bigint size from documents),
per as (select source, count(*)::bigint docs, sum(size)::bigint source_size, (row_number() over (order by source is null, source) - 1) % {mixing.CYCLE} + 1 w from d group by source),
ratio as (select *, {mixing.CAP} * source_size cap, ({mixing.CAP} * source_size) / w ratio from per),
run as (select *, (select sum(source_size) from per)::bigint - coalesce(sum(cap) over o, 0)::bigint left_, (select sum(w) from per)::bigint - coalesce(sum(w) over o, 0)::bigint weight
  from ratio window o as (order by ratio, source is null, source rows between unbounded preceding and 1 preceding)),
first as (select ratio from_, left_ / weight level from run where cap * weight > left_ * w order by ratio, level desc limit 1),
goal as (select source, docs, source_size, case when from_ is null or ratio < from_ then cap::double else level * w end target from ratio left join first on true),
rate as (select *, case when source_size > 0 then target / source_size else 0.0 end ratio from goal),
need as (select *, least(floor(ratio), {mixing.CAP})::bigint whole, target - least(floor(ratio), {mixing.CAP})::bigint * source_size need from rate),
odds as (select *, greatest(1e-12::double, least(1 - 1e-12::double, case when source_size > 0 then need / source_size else 0.5 end)) p from need),
drawn as (select d.*, docs, source_size, target, whole, need, p, (('0x' || substr(md5('{mixing.SEED}:' || doc_id::varchar), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double u from d join odds o on d.source is not distinct from o.source),
ranked as (select *, (u / (1 - u)) / (p / (1 - p) * case when size > 0 then sqrt(size::double * docs::double / source_size::double) else 1.0::double end) q from drawn),
placed as (select * exclude (q), q / (1 + q) r, floor(q / (1 + q) * {mixing.BUCKETS})::bigint b from ranked),
summed as (select *, sum(size) over (partition by source order by r, doc_id)::bigint upto from placed),
edges as (select source, b edge, n_upto - n before_ from (select source, b, sum(size)::bigint n, sum(sum(size)) over (partition by source order by b)::bigint n_upto, any_value(need) need from placed group by source, b) where n_upto - n <= need and need < n_upto),
cut as (select s.*, edge, before_, case when edge is null then s.need > 0 else b < edge or (b = edge and upto <= s.need) end taken_ from summed s left join edges e on s.source is not distinct from e.source),
gaps as (select source, case when any_value(edge) is null then 0.0 else any_value(need) - coalesce(max(case when b = edge and taken_ then upto end), any_value(before_)) end gap from cut group by source),
-- each later document that still fits, in order of rank: a fold over the ordered list
later as (select c.source, any_value(gap) gap, list({{'g': 0.0::double, 'z': size::double, 'i': doc_id, 'a': []::bigint[]}} order by r, doc_id) xs
  from cut c join gaps g on c.source is not distinct from g.source where gap > 0 and size > 0 and not taken_ group by c.source),
fold as (select source, list_reduce(list_prepend({{'g': gap::double, 'z': 0.0::double, 'i': null::bigint, 'a': []::bigint[]}}, xs),
  lambda a, x: case when x.z <= a.g then {{'g': a.g - x.z, 'z': 0.0::double, 'i': null::bigint, 'a': list_append(a.a, x.i)}} else a end) f from later),
added as (select unnest(f.a) doc_id from fold),
held as (select c.*, whole + case when size = 0 then 0 when taken_ or a.doc_id is not null then 1 else 0 end copies from cut c left join added a on a.doc_id = c.doc_id),
short as (select source, any_value(target) - sum(size * copies)::bigint short from held group by source),
last_ as (select doc_id from (select doc_id, row_number() over (partition by h.source order by size desc, doc_id) k from held h join short s on h.source is not distinct from s.source
  where copies < {mixing.CAP} and size > 0 and size <= short) where k = 1)
select h.doc_id, size, source_size, target, size * (copies + case when l.doc_id is not null then 1 else 0 end) taken from held h left join last_ l on l.doc_id = h.doc_id
"""

JACCARD = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:least(i + 3, len(ws))], ' ') s from w, unnest(range(1, greatest(2, len(ws) - 2))) t(i) where len(ws) > 0),
n as (select doc_id, count(*)::bigint n from s group by 1),
same as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from same join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
both_ as (select a, b from link union select b, a from link),
reach as (select a, b from both_ union select r.a, l.b from reach r join both_ l on r.b = l.a),
least_ as (select a, min(b) c from reach group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) component_id from w left join n on n.doc_id = w.doc_id left join least_ on a = w.doc_id
"""

RULES = rf"""
with d as (select doc_id, coalesce(text, '') text, {WORDS} ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') s from d, unnest(range(1, len(ws) - 3)) t(i)),
many as (select doc_id, s from win group by 1, 2 having count(*) > 1),
hit as (select doc_id, count(distinct i + k)::bigint n from win join many using (doc_id, s), unnest(range(5)) t(k) group by 1),
m as (select d.*, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint n_symbols,
  len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words from d left join hit on hit.doc_id = d.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 2 * n_symbols > n_words or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words
    or 2 * (length(text) - length(replace(text, '!', ''))) > n_words or (n_words >= 20 and 2 * length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) > word_chars) or (n_words >= 50 and 20 * len(list_distinct(ws)) < n_words)) kept
from m
"""
