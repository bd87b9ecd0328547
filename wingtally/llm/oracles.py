"""SQL for DuckDB that gives the rows of operators whose contract SQL can state, from all pairs and all strings."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORD = r"[^\x20\x09-\x0D]+"

#: Sets are compared pair by pair where they share a shingle; components are all that links reach.
JACCARD = f"""
with recursive w as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
s as (select r, unnest(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' ')))) as s from w where len(w) > 0),
n as (select r, count(*) as n from s group by r),
p as (select a.r as a, b.r as b, count(*) as m from s a join s b on a.s = b.s and a.r < b.r group by all),
l as (select a, b from p join n x on x.r = a join n y on y.r = b where 100 * m >= 75 * (x.n + y.n - m)),
e as (select a, b from l union all select b, a from l),
reach(a, b) as (select r, r from w union select reach.a, e.b from reach join e on e.a = reach.b),
c as (select reach.a as r, min(w.doc_id) as component_id from reach join w on w.r = reach.b group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id from w left join n using (r) left join c using (r)
"""

#: Every string of 50 bytes with the least doc_id that has it; those of a smaller document are merged to runs.
PASSAGES = """
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
s as (select r, doc_id, i, b[i + 1:i + 50] as s from d, lateral (select unnest(range(0, octet_length(b) - 49)) as i)),
m as (select s, min(doc_id) as least from s group by s having count(*) > 1),
h as (select r, i from s join m using (s) where least < doc_id),
g as (select r, i, case when i <= lag(i) over w + 50 then 0 else 1 end as fresh from h window w as (partition by r order by i)),
k as (select r, i, sum(fresh) over (partition by r order by i) as k from g),
x as (select r, min(i) as a, max(i) + 50 as z from k group by r, k),
t as (select r, count(*) as n_spans, sum(z - a) as n_removed from x group by r),
y as (select r, z as a, lead(a) over (partition by r order by a) as z from x union all select r, 0, min(a) from x group by r),
q as (select r, string_agg(hex(b[y.a + 1:coalesce(y.z, octet_length(b))]), '' order by y.a) as kept from y join d using (r) group by r)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(case when n_spans is null then b else unhex(kept) end) as kept_sha256
from d left join t using (r) left join q using (r)
"""

#: Words by windows of 8, lines by host.
LINE_RULES = f"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
i as (select r, w, unnest(range(1, len(w) - 6)) as i from d),
k as (select r, i, array_to_string(w[i:i + 7], ' ') as k from i),
o as (select r, i from k where (r, k) in (select (r, k) from k group by r, k having count(*) > 1)),
rw as (select r, count(distinct i + j) as n_repeat_words from o, range(0, 8) t(j) group by r),
ln as (select r, doc_id, source, unnest(string_split(text, chr(10))) as line from d),
lw as (select r, doc_id, source, line, regexp_extract_all(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_WORD}') as w from ln),
lo as (select r, doc_id, source, line, array_to_string(w, ' ') as norm, len(w) as n from lw where len(w) > 0),
dup as (select r, count(*) - count(distinct line) as n_dup_lines from lo group by r),
host as (select source, count(distinct doc_id) as host_docs from documents group by source),
line as (select source, norm, count(distinct doc_id) as n_docs from lo group by all),
often as (select line.source, norm from line join host on line.source is not distinct from host.source where n_docs > 20 and n_docs > 0.02 * host_docs),
gone as (select r, sum(n)::bigint as removed_words from lo join often on lo.norm = often.norm and lo.source is not distinct from often.source group by r),
f as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(removed_words, 0)::bigint as removed_words from d left join rw using (r) left join dup using (r) left join gone using (r))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and removed_words <= n_words * 0.5 as kept from f
"""
