"""DuckDB SQL that gives the same rows as the queries which SQL can express."""

from __future__ import annotations

from parchmint.llm import licenses, quality

_TARGETS = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
t as (select source, sum(size)::bigint as n from d group by source),
w as (select source, n, [3, 1, 2][1 + (row_number() over (order by source is null, source) - 1) % 3] as weight from t),
c as (select *, 2.0::double * n as cap, (2.0::double * n) / weight as turn from w),
-- how many of the sources that fill up first are capped: those whose level stays below the next one's turn
l as (
  select *, coalesce(sum(cap) over before, 0)::double as capped, sum(weight) over after as open
  from c window before as (order by turn, source rows between unbounded preceding and 1 preceding), after as (order by turn, source rows between current row and unbounded following)),
v as (select *, ((select 1.5::double * sum(n) from t) - capped) / open as level from l),
g as (select source, n as source_size, weight, case when level * weight > cap then cap end as filled from v),
f as (select (1.5::double * (select sum(n) from t) - coalesce(sum(filled), 0)) / sum(weight) filter (filled is null) as level from g)
select doc_id, size, source_size, round(coalesce(filled, (select level from f) * weight), 6) as target from d join g on d.source is not distinct from g.source
"""

_PAYLOADS = """
with d as (select doc_id, strlen(coalesce(text, ''))::bigint as n, encode(coalesce(text, '')) as b from documents),
p as (select *, greatest(1, (n + 575) // 576) * 576 as size from d)
select doc_id, n as n_bytes, size::bigint as payload_bytes, sha256(b || unhex(repeat('FF', (size - n)::int))) as payload_sha256, true as frames_ok from p
"""


def _licenses() -> str:
    places = " union all ".join(f"select rid, i - 1 as at_, '{label}' as label from w where words[i : i + {len(phrase.split()) - 1}] = {phrase.split()!r}" for phrase, label in licenses.BASE)
    return rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
w as (select rid, words, unnest(range(1, len(words) + 1)) as i from d where list_contains(words, 'mit') or list_contains(words, 'apache') or list_contains(words, 'cc')),
p as ({places}),
s as (select rid, count(*) as n, min(at_) as low, max(at_) as high, string_agg(distinct label, ',' order by label) as labels from p group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0) as n_base, low as first_word, high as last_word, coalesce(labels, '') as base_labels from d left join s using (rid)
"""


_SECRETS = r"""
select doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12))::bigint as n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18))::bigint as n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16))::bigint as n_hex from documents
"""


def _quality() -> str:
    """The quality rules; patterns and thresholds come from the operator."""
    sql = lambda p: p.replace("'", "''")  # noqa: E731
    upper, digits, marks = (f"length(regexp_replace(t, '{sql(p)}', '', 'g'))" for p in (quality.UPPER, quality.DIGITS, quality.MARKS))
    return rf"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
a as (
  select rid, doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    regexp_extract_all(lower(t), '{quality.LETTERS}') as lw,
    length(t) as n, length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')) as blank, {upper} as upper_, {digits} as digits, {marks} as marks,
    length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')) as n_symbols from d),
df as (select lang, word, count(*) as n from (select rid, lang, unnest(list_distinct(lw)) as word from a where lang is not null) where length(word) <= {quality.SHORT} group by lang, word),
common as (select lang, word from df qualify row_number() over (partition by lang order by n desc, word) <= {quality.BINS}),
tri as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from a where len(w) >= 3)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from tri) where n > 1),
rep as (select rid, count(distinct j) as n from (select rid, unnest([i, i + 1, i + 2]) as j from twice) group by rid),
f as (
  select a.rid, doc_id, lang, len(w)::bigint as n_words, (a.n - blank)::bigint as word_chars, n_symbols::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
    [upper_, digits, blank, marks, n_symbols, strlen(t) - a.n, a.n - upper_ - digits - blank - marks - n_symbols] as k, lw
  from a left join rep using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
hist as (
  select rid, lang, base_failed, 'class' as kind, unnest(range({quality.KINDS}))::varchar as bin, unnest(k) as n from b where lang is not null
  union all
  select rid, any_value(x.lang), any_value(base_failed), 'word', coalesce('=' || common.word, 'other'), count(*)
  from (select rid, lang, base_failed, unnest(lw) as word from b where lang is not null) x left join common on x.lang = common.lang and x.word = common.word group by rid, common.word),
known as (select lang from b where not base_failed and lang in (select lang from common) group by lang having count(*) >= {quality.MIN_TEXTS}),
ref as (select lang, kind, bin, sum(n) as n from hist where not base_failed and lang in (select lang from known) group by all),
q as (select lang, kind, bin, n / sum(n) over (partition by lang, kind) as q from ref),
size_ as (select rid, lang, kind, sum(n) as total from hist where lang in (select lang from known) group by all),
pairs as (
  select s.rid, s.kind, q.q, coalesce(hist.n, 0) / s.total as p, s.total
  from size_ s join q on s.kind = q.kind and s.lang = q.lang left join hist on hist.rid = s.rid and hist.kind = s.kind and hist.bin = q.bin where s.total > 0
  union all
  select s.rid, s.kind, 0, hist.n / s.total, s.total
  from hist join size_ s using (rid, kind) where hist.n > 0 and not exists (select 1 from q where q.lang = s.lang and q.kind = hist.kind and q.bin = hist.bin)),
js as (
  select rid, kind, any_value(total) as total, sqrt(greatest(sum(
    case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2 / ln(2.0), 0)) as far
  from pairs group by rid, kind),
bad as (
  select distinct rid from js
  where kind = 'class' and total >= {quality.MIN_CHARS} and far > {quality.MAX_CLASS}
     or kind = 'word' and total >= {quality.MIN_LETTER_WORDS} and far > {quality.FLOOR} + {quality.SPREAD} / sqrt(total))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rid not in (select rid from bad) as kept from b
"""


_FIM = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
r as (select *, len(u)::bigint as n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) as k from d),
c as (
  select *, least(k[1] % (n + 1), k[2] % (n + 1)) as low, greatest(k[1] % (n + 1), k[2] % (n + 1)) as high,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when k[4] % 100 < 50 then 'spm' else 'psm' end as form from r),
p as (
  select doc_id, t, n, form, coalesce(array_to_string(u[1:low], ''), '') as prefix, coalesce(array_to_string(u[low + 1:high], ''), '') as middle, coalesce(array_to_string(u[high + 1:n], ''), '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256 from p
"""

# The plain way: the cheapest audit string of each state, turn by turn, as text.
_CONVERSATIONS = r"""
with recursive r as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
h as (
  select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::bigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: xor(x >> 1, case when x & 1 = 1 then 3988292384::bigint else 0 end))), 4294967295::bigint) % 20 as how from r),
d as (
  select conv_id, turn, case when how = 4 then 'user' else role end as role, case how when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when how = 3 then 2 else 1 end)) as copy from h where how <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i, regexp_replace(text, '[ 	-]+$', '') as rest from d),
f as (
  select *, case when rest = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(rest, 1) not in ('.', '!', '?') then 'truncated' end as fault,
    left(role, 1) as c, lag(left(role, 1)) over (partition by conv_id order by i) as c_before from o),
next(p, c, s) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins as (
  select p, p as s, '' as run, 0 as paid from range(4) t(p) union all select p, s, 'I', 5 from next where c <> 's'
  union all select a.p, b.s, 'II', 10 from next a join next b on a.s = b.p where a.c <> 's' and b.c <> 's'),
edits as (select ins.p, run || 'D' as code, paid + 2 as paid, s, null::varchar as c, 'D' as what from ins union all
  select ins.p, run || what, paid + cost, next.s, next.c, what from ins join next on ins.s = next.p, (values ('K', 0), ('R', 1)) w(what, cost) where what = 'K' or next.c <> 's'),
best as (
  select conv_id, 0::bigint as i, 0 as s, {'cost': 0::bigint, 'audit': ''} as b from (select distinct conv_id from d)
  union all
  select best.conv_id, best.i + 1, edits.s, min({'cost': b.cost + edits.paid + case when fault = 'truncated' and what <> 'D' then 5 else 0 end, 'audit': b.audit || code})
  from best join f on best.conv_id is not distinct from f.conv_id and f.i = best.i + 1 join edits on edits.p = best.s
    and (what = 'D' or coalesce(fault, '') not in ('blank', 'duplicate') and (what = 'R' or edits.c = f.c))
  group by best.conv_id, best.i, edits.s),
ends as (
  select conv_id, min({'cost': b.cost + 5 * n, 'audit': b.audit || repeat('I', n)}) as b
  from best join (values (0, 0), (1, 2), (2, 1), (3, 0)) t(s, n) using (s) join (select conv_id as c, max(i) as n_rows from f group by conv_id) m on best.conv_id is not distinct from m.c and best.i = m.n_rows group by conv_id),
letters as (select conv_id, b.audit as audit, unnest(range(1, length(b.audit) + 1)) as j from ends),
taken as (select conv_id, j, audit[j] as e, sum(case when audit[j] <> 'I' then 1 else 0 end) over (partition by conv_id order by j) as i from letters),
kept as (
  select t.conv_id, j, e, case when e = 'I' then '' else f.text end as text, f.role, row_number() over (partition by t.conv_id order by j) as place
  from taken t left join f on t.conv_id is not distinct from f.conv_id and t.i = f.i where e <> 'D'),
told as (
  select conv_id, j, text, case when e = 'K' then role when (place + bool_or(place = 1 and e = 'K' and role[1] = 's') over (partition by conv_id)::int) % 2 = 1 then 'user' else 'assistant' end as role from kept),
texts as (select conv_id, sha256(string_agg(role || ':' || text, chr(10) order by j)) as digest from told group by conv_id),
sums as (
  select conv_id, case when max(turn) is null then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (i > 1 and c_before || c not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(b.cost, 0)::bigint as cost, coalesce(b.audit, '') as audit, coalesce(digest, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) e left join sums on e.conv_id is not distinct from sums.conv_id left join ends on e.conv_id is not distinct from ends.conv_id left join texts on e.conv_id is not distinct from texts.conv_id
"""


SQL: dict[str, str] = {
    "op11_conversation_repair": _CONVERSATIONS,
    "op13_fill_in_middle": _FIM,
    "op2_quality_rules": _quality(),
    "media_payloads": _PAYLOADS,
    "base_license_places": _licenses(),
    "base_secret_counts": _SECRETS,
    "bpe_decoded": "select doc_id, sha256(coalesce(text, '')) as decoded_sha256 from documents",
    "mix_targets": _TARGETS,
}
