"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP3 = f"""
with w as (select doc_id, {WORDS.format(text="coalesce(text, '')")} as ws from documents),
hashed as (select doc_id, list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(list_slice(ws, i, i + 19), ' '))) as hs from w where len(ws) >= 20),
windows as (select doc_id, unnest(hs) as h, generate_subscripts(hs, 1) as s from hashed),
later as (select doc_id, s from (select doc_id, s, row_number() over (partition by h order by doc_id, s) as n from windows) where n > 1),
gone as (select distinct doc_id, s + k as i from later, range(20) r(k)),
each as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
kept as (select e.doc_id, string_agg(word, ' ' order by e.i) as text, count(*) as n from each e left join gone g on g.doc_id = e.doc_id and g.i = e.i where g.i is null group by e.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from w left join kept k on k.doc_id = w.doc_id"""

OP8 = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as hx from documents),
hashed as (select doc_id, list_transform(range(0, length(hx) // 2 - 199), lambda i: md5(substr(hx, 2 * i + 1, 400))) as hs from t where length(hx) >= 400),
windows as (select doc_id, unnest(hs) as h, generate_subscripts(hs, 1) - 1 as s from hashed),
again as (select doc_id, s from (select doc_id, s, count(*) over (partition by h) as n from windows) where n > 1),
runs as (select doc_id, s, s > coalesce(max(s) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding) + 200, -1) as new from again),
spans as (select doc_id, min(s) as a, max(s) + 200 as b from (select doc_id, s, sum(new::int) over (partition by doc_id order by s) as k from runs) group by doc_id, k),
cuts as (select doc_id, list(a order by a) as a, list(b order by a) as b, sum(b - a)::bigint as n, count(*) as spans from spans group by doc_id)
select t.doc_id, (length(hx) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(case when a is null then hx else array_to_string(list_transform(range(0, len(a) + 1), lambda i: substr(hx, 2 * (case when i = 0 then 0 else b[i] end)::bigint + 1, 2 * ((case when i = len(a) then length(hx) // 2 else a[i + 1] end) - (case when i = 0 then 0 else b[i] end))::bigint)), '') end)) as kept_sha256
from t left join cuts on cuts.doc_id = t.doc_id"""

OP6 = f"""
with recursive w as (select doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
sets as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) end as s from w),
each as (select doc_id, len(s) as n, unnest(s) as x from sets),
links as (select a.doc_id as a, b.doc_id as b from each a join each b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) as (select doc_id, doc_id from sets union select r.a, l.b from reach r join links l on l.a = r.b)
select s.doc_id, len(s.s)::bigint as n_shingles, (select min(b) from reach r where r.a = s.doc_id) as component_id from sets s"""
