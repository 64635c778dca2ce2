"""DuckDB SQL for the operators that SQL can express; it reads whole tables."""

BLANK = r"[\x20\x09-\x0D]+"

#: Measurements and ledger, from a relation ``docs(doc_id, text)``.
LEDGER = rf"""
words as (select k, unnest(w) as word, generate_subscripts(w, 1) as i
  from (select k, list_filter(regexp_split_to_array(t, '{BLANK}'), lambda x: x <> '') as w from src)),
per_word as (select k, count(*) as n_words, sum(length(word)) as word_chars from words group by k),
grams as (select k, i, word as a, lead(word) over (partition by k order by i) as b, lead(word, 2) over (partition by k order by i) as c from words),
again as (select k, i from (select k, i, count(*) over (partition by k, a, b, c) as n from grams where c is not null) where n > 1),
covered as (select k, count(distinct i + o) as n_repeat_words from again, (values (0), (1), (2)) as v(o) group by k),
lines as (select k, unnest(string_split(t, chr(10))) as line from src),
per_line as (select k, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by k),
measured as (select src.k, doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, coalesce(n_lines, 0)::bigint as n_lines,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) as n_upper, length(regexp_replace(t, '\P{{L}}+', '', 'g')) as n_letters,
    length(regexp_replace(t, '[^!]+', '', 'g')) as n_bangs
  from src left join per_word using (k) left join covered using (k) left join per_line using (k)),
judged as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 100 * n_symbols > 10 * n_words then 4 else 0 end + case when 100 * n_dup_lines > 50 * n_lines then 8 else 0 end
    + case when 100 * n_upper > 50 * n_letters then 16 else 0 end + case when word_chars < 2 * n_words or word_chars > 15 * n_words then 32 else 0 end
    + case when 100 * n_bangs > 10 * n_words then 64 else 0 end)::bigint as fail_bits from measured)"""

OP10 = f"""
with src as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
{LEDGER}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits
from judged"""

OP4 = r"""
with docs as (select distinct doc_id as d, text as t from documents where text is not null),
cut as (select d, t, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as idx from docs),
worded as (select d, t, line, idx, row_number() over (partition by d, t order by idx) - 1 as pos,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as w
  from cut where regexp_matches(line, '[^\x20\x09-\x0D]')),
equal as (select a.d, a.t, b.d as d2, b.t as t2, a.pos - b.pos as shift, a.pos, a.idx, a.w
  from worded a join worded b on a.line = b.line and (b.d < a.d or (b.d = a.d and (b.t < a.t or (b.t = a.t and b.pos < a.pos))))),
runs as (select *, pos - row_number() over (partition by d, t, d2, t2, shift order by pos) as run from equal),
gone as (select distinct d, t, idx from (select d, t, idx, sum(w) over (partition by d, t, d2, t2, shift, run) as total from runs) where total >= 50),
kept as (select c.d, c.t, string_agg(c.line, chr(10) order by c.idx) as text from cut c anti join gone g on g.d = c.d and g.t = c.t and g.idx = c.idx group by c.d, c.t),
counts as (select d, t, count(*) as n_lines from worded group by d, t),
lost as (select d, t, count(*) as n_removed from gone group by d, t)
select x.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
  case when x.text is null then null else coalesce(k.text, '') end as text
from documents x left join counts c on c.d = x.doc_id and c.t = x.text left join lost l on l.d = x.doc_id and l.t = x.text
left join kept k on k.d = x.doc_id and k.t = x.text"""

OP8 = r"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from words),
sized as (select doc_id, len(s) as n, s from sets),
flat as (select doc_id, n, unnest(s) as g from sized),
shared as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as m
  from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by a.doc_id, b.doc_id),
links as (select x, y from shared where 100 * m >= 85 * (nx + ny - m)),
ways as (select x, y from links union all select y, x from links),
reached(v, c) as (select doc_id, doc_id from documents union select w.y, r.c from reached r join ways w on w.x = r.v),
least_ as (select v, min(c) as c from reached group by v)
select s.doc_id, s.n::bigint as n_shingles, l.c as component_id from sized s join least_ l on l.v = s.doc_id"""
