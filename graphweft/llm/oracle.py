"""DuckDB SQL for the queries of this subpackage."""

from __future__ import annotations

from . import mixing, quality


def _quality() -> str:
    first = "case " + " ".join(f"when {r} > {c!r} then {i + 1}" for i, (r, c) in enumerate(quality.PATH)) + " end"
    alpha, top, white = 0.05, len(quality.PATH), r"[\x20\x09-\x0D]"
    return rf"""
with t as (
  select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents
), w as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from t
), grams as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3)
), repeated as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from grams) where n > 1
), covered as (
  select doc_id, count(distinct i + k) as n from repeated, (values (0), (1), (2)) as s(k) group by doc_id
), c as (
  select w.doc_id, stratum, len(words)::bigint as n_words,
    length(regexp_replace(text, '{white}', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_upper,
    (length(text) - length(regexp_replace(text, '[!]', '', 'g')))::bigint as n_marks,
    len(lines) as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words
  from w left join covered on w.doc_id = covered.doc_id
), f as (
  select c.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    case when n_words = 0 then 0 else n_symbols / n_words::double end as symbol_ratio,
    case when n_lines = 0 then 0 else n_dup_lines / n_lines::double end as dup_line_ratio,
    case when n_words = 0 then 0 else n_repeat_words / n_words::double end as repeat_ratio,
    case when word_chars = 0 then 0 else n_upper / word_chars::double end as upper_ratio,
    case when n_words = 0 then 0 else n_marks / n_words::double end as mark_ratio,
    quality
  from c left join (select doc_id, min(quality) as quality from labels where quality in (0, 1) group by doc_id) l on c.doc_id = l.doc_id
), placed as (
  select *, {first} as first from f
), counted as (
  select stratum, first, sum(quality) as good, count(*) filter (where quality = 0) as bad from placed where quality is not null and not base_failed group by all
), tried as (
  select stratum, step, sum(good)::bigint as n_good, coalesce(sum(good) filter (where first <= step), 0)::bigint as good_lost, coalesce(sum(bad) filter (where first <= step), 0)::bigint as bad_caught
  from counted, range(1, {top} + 1) as s(step) group by all
), tested as (
  select *, n_good > 0 and list_sum(list_transform(range(0, good_lost + 1), lambda i:
      case when i > n_good then 0 else exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(greatest(n_good - i, 0) + 1) + i * ln({alpha!r}) + (n_good - i) * ln(1 - {alpha!r})) end))
      <= 0.05 / (select count(distinct stratum) from tried) as passed
  from tried
), chosen as (
  select stratum, arg_max(step, (bad_caught - 20.0 * good_lost, -step)) as step
  from (select *, coalesce(min(step) filter (where not passed) over (partition by stratum), {top} + 1) as failed_at from tested)
  where step < failed_at and bad_caught - 20.0 * good_lost > 0 group by stratum
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(first <= step, false) as kept
from placed p left join chosen c on p.stratum = c.stratum
"""


QUALITY = _quality()

NEAR_DUPLICATES = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), g as materialized (
  select distinct doc_id, case when len(words) < 4 then array_to_string(words, ' ') else array_to_string(words[i : i + 3], ' ') end as gram
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as i from w where len(words) > 0)
), sizes as materialized (select doc_id, count(*) as n from g group by doc_id),
links as materialized (
  select p.a, p.b from (select x.doc_id as a, y.doc_id as b, count(*) as both from g x join g y on x.gram = y.gram and x.doc_id < y.doc_id group by all) p
  join sizes s on s.doc_id = p.a join sizes t on t.doc_id = p.b where 100 * p.both >= 80 * (s.n + t.n - p.both)
), ends as materialized (select a as u, b as v from links union all select b, a from links),
reach(u, v) as (select u, v from ends union select r.u, e.v from reach r join ends e on r.v = e.u)
select d.doc_id, coalesce(sizes.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.v, d.doc_id)) as component_id,
  d.doc_id <= coalesce(m.v, d.doc_id) as kept
from documents d left join sizes on d.doc_id = sizes.doc_id
left join (select u, min(v) as v from reach group by u) m on d.doc_id = m.u
"""

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = rf"""
with d as materialized (select doc_id, {_ALNUM} as words from documents),
b as (select item_id::varchar as item, {_ALNUM} as words from benchmark),
windows as materialized (
  select distinct item, least(len(words), 10) as width, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') as gram
  from (select item, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) as i from b where len(words) > 0)
), widths as (select distinct width from windows),
places as (
  select doc_id, width, i, array_to_string(words[i : i + width - 1], ' ') as gram
  from (select doc_id, words, width, unnest(range(1, len(words) - width + 2)) as i from d, widths where len(words) >= width)
), hits as materialized (select doc_id, places.width, i, item from places join windows on places.gram = windows.gram and places.width = windows.width),
words as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + width)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item) as n, array_to_string(list_sort(list(distinct item)), ',') as names from hits group by doc_id),
-- proximity: the three rarest terms of a window, the second and third at most two words off their place beside the first
iw as materialized (select k, item, unnest(words) as w, generate_subscripts(words, 1) as o, len(words) as n from (select row_number() over () as k, item, words from b)),
dw as materialized (select doc_id, i, w from (select doc_id, unnest(words) as w, generate_subscripts(words, 1) as i from d) where w in (select w from iw)),
freq as (select w, count(*) as n from dw group by w),
ranked as (
  select k, item, start, o, iw.w, row_number() over (partition by k, start order by coalesce(freq.n, 0), o) as r
  from (select *, unnest(range(greatest(o - least(n, 10) + 1, 1), least(o, n - least(n, 10) + 1) + 1)) as start from iw) iw left join freq on iw.w = freq.w
), probes as materialized (
  select distinct item, o0, w0, coalesce(o1, o0) as o1, coalesce(w1, w0) as w1, coalesce(o2, o1, o0) as o2, coalesce(w2, w1, w0) as w2
  from (
    select any_value(item) as item, max(o) filter (where r = 1) as o0, max(w) filter (where r = 1) as w0, max(o) filter (where r = 2) as o1,
      max(w) filter (where r = 2) as w1, max(o) filter (where r = 3) as o2, max(w) filter (where r = 3) as w2
    from ranked group by k, start
  )
), second as materialized (
  select distinct x.doc_id, p.item, x.i - p.o0 as shift, o2, w2
  from probes p join dw x on x.w = p.w0 join dw y on y.doc_id = x.doc_id and y.w = p.w1
  where y.i between x.i - p.o0 + p.o1 - 2 and x.i - p.o0 + p.o1 + 2
), near as (
  select s.doc_id, count(distinct item) as n from second s join dw z on z.doc_id = s.doc_id and z.w = s.w2
  where z.i between s.shift + o2 - 2 and s.shift + o2 + 2 group by s.doc_id
)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(words.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items,
  sha256(coalesce(items.names, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated, coalesce(near.n, 0)::bigint as n_near_items
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id left join near on d.doc_id = near.doc_id
"""


#: Rounds of raking in the SQL, which can't stop at a tolerance: enough to get within 1e-12 on the tables given.
SQL_ROUNDS = 40


def _mixture() -> str:
    columns = {"_source": "source", "_lang": "lang", "_topic": "topic"}
    steps, last = [], "cells"
    for i in range(SQL_ROUNDS):
        for m in mixing.MARGINS:
            c = columns[m]
            steps.append(f"r{i}{m} as materialized (select x.source, x.lang, x.topic, tokens, fitted * share / nullif(sum(fitted) over (partition by x.{c}), 0) as fitted from {last} x join t{m} s on x.{c} = s.v)")
            last = f"r{i}{m}"
    shares = []
    for m, c in columns.items():
        listed = ", ".join(f"('{v}', {x!r}::double)" for v, x in mixing.TARGETS[m].items())
        rest = max(0.0, 1.0 - sum(mixing.TARGETS[m].values()))
        shares.append(
            f"t{m} as materialized (select v, share / sum(share) over () as share from (select c.{c} as v, coalesce(l.x, {rest!r}::double * sum(tokens) / sum(case when l.x is null then sum(tokens) end) over ()) as share"
            f" from cells c left join (values {listed}) as l(v, x) on c.{c} = l.v group by c.{c}, l.x))"
        )
    shares = ", ".join(shares)
    return rf"""
with d as materialized (
  select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang,
    case when regexp_matches(lower(coalesce(text, '')), 'licen[sc]e|copyright') then 'legal'
      when contains(coalesce(text, ''), ' | ') then 'table' when contains(coalesce(text, ''), '@') then 'contact'
      when contains(coalesce(text, ''), chr(10) || chr(10)) then 'sections' else 'prose' end as topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens
  from documents
), cells as materialized (select source, lang, topic, sum(n_tokens)::double as tokens, sum(n_tokens)::double as fitted from d group by all),
{shares},
{", ".join(steps)},
p as (select source, lang, topic, coalesce(fitted / nullif(tokens, 0) / (select max(fitted / nullif(tokens, 0)) from {last}), 1.0) as probability from {last})
select doc_id, d.source, d.lang, d.topic, n_tokens, round(probability, 9) as probability,
  ('0x' || substr(md5(doc_id::varchar || ':mix'), 1, 8))::bigint / 4294967296.0::double < probability as sampled
from d join p on d.source = p.source and d.lang = p.lang and d.topic = p.topic
"""


MIXTURE = _mixture()

_TRIM = r"regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"

LINES = rf"""
with l as materialized (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents
), b as materialized (
  select doc_id, i, {_TRIM} as t, row_number() over (partition by doc_id order by i) as k from l where regexp_matches(x, '[^\x20\x09-\x0D]')
), w as materialized (
  select a.doc_id, a.k, a.t || chr(10) || b2.t || chr(10) || c.t as gram
  from b a join b b2 on a.doc_id = b2.doc_id and b2.k = a.k + 1 join b c on a.doc_id = c.doc_id and c.k = a.k + 2
), later as (select doc_id, k from (select *, row_number() over (partition by gram order by doc_id, k) as n from w) where n > 1),
gone as (select distinct doc_id, k + s as k from later, (values (0), (1), (2)) as v(s)),
kept as (
  select l.doc_id, l.i, l.x, b.k from l left join b on l.doc_id = b.doc_id and l.i = b.i
  where b.k is null or not exists (select 1 from gone g where g.doc_id = b.doc_id and g.k = b.k)
)
select d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::bigint as n_lines,
  (len(string_split(coalesce(d.text, ''), chr(10))) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.x, '')) as kept_sha256
from documents d left join (select doc_id, count(*) as n, string_agg(x, chr(10) order by i) as x from kept group by doc_id) k on d.doc_id = k.doc_id
"""

REPEATS = r"""
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
blocks as materialized (
  -- 256 bytes each and the 49 after them, as a long text's far substrings are slow
  select doc_id, b, length(x) // 2 as n, substr(x, 512 * b + 1, 512 + 98) as y from (select doc_id, x, unnest(range(0, length(x) // 512 + 1)) as b from d)
), g as materialized (
  select doc_id, 256 * b + p as p, substr(y, 2 * p + 1, 100) as gram
  from (select doc_id, b, n, y, unnest(range(0, least(256, greatest(n - 49 - 256 * b, 0)))) as p from blocks)
), first as (select gram, min(doc_id) as low from g group by gram having min(doc_id) < max(doc_id)),
starts as materialized (select doc_id, p from g join first on g.gram = first.gram where doc_id > low),
bytes as materialized (
  select b.doc_id, b.p, b.y, max(s.p) over (partition by b.doc_id order by b.p) as near
  from (
    select doc_id, 256 * b + p as p, substr(y, 2 * p + 1, 2) as y
    from (select doc_id, b, y, unnest(range(0, least(256, n - 256 * b))) as p from blocks where doc_id in (select doc_id from starts))
  ) b
  left join starts s on s.doc_id = b.doc_id and s.p = b.p
), marked as (select doc_id, p, y, coalesce(p - near < 50, false) as gone from bytes),
spans as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as opens from marked),
found as (
  select doc_id, count(*) filter (where gone) as n, count(*) filter (where opens) as spans, coalesce(string_agg(y, '' order by p) filter (where not gone), '') as kept
  from spans group by doc_id
)
select d.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, x))) as kept_sha256
from d left join found on d.doc_id = found.doc_id
"""


COPIES = r"""
select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by bare)::bigint as group_size,
  row_number() over best = 1 as kept, sha256(bare) as text_sha256
from (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare from documents)
window best as (partition by bare order by length(text) desc, doc_id nulls last)
"""

#: CRC-32 a byte a round over all (document, run) pairs; neighbours by their texts without one place.
SPELLING = r"""
with recursive bits as (
  select i, i::ubigint as v, 0 as k from range(256) as r(i)
  union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end, k + 1 from bits where k < 8
), remainders as (
  select i::ubigint as i, v from bits where k = 8
), pairs as (
  select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as w from documents) group by all
), texts as (
  select row_number() over () as p, doc_id, run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from pairs
), crc as (
  select p, x, 4294967295::ubigint as c from texts
  union all select p, substr(x, 3), xor(c >> 8, v) from crc join remainders on i = xor(c, ('0x' || substr(x, 1, 2))::ubigint) & 255 where x <> ''
), hashed as (
  select run, n, xor(c, 4294967295::ubigint) as h from crc join texts using (p) where crc.x = ''
), counted as (
  select word, sum(n)::bigint as n
  from (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed)
  where length(word) >= 6 group by 1 having sum(n) >= 5
), cut as (
  select word, i, left(word, i::int) || substr(word, i::int + 2) as rest from (select word, unnest(range(length(word))) as i from counted)
), near as (
  select a.word, b.word as other from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word from cut a join counted b on a.rest = b.word
  union select b.word, a.word from cut a join counted b on a.rest = b.word
), best as (
  select near.word, count(*) as n_near, min({'less': -c.n, 'word': other}) as best from near join counted c on c.word = other group by 1
), forms as (
  select c.word, n, coalesce(n_near, 0)::bigint as n_near, case when -best.less >= 5 * n then best.word end as form, case when -best.less >= 5 * n then -best.less end as form_n
  from counted c left join best b on c.word = b.word
), walk as (
  select word, word as at from forms
  union all select walk.word, form from walk join forms on forms.word = walk.at where form is not null
)
select f.word, f.form, w.at as root, f.n, f.n_near, f.form_n
from forms f join walk w on w.word = f.word join forms g on g.word = w.at and g.form is null
"""
