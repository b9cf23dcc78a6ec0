"""DuckDB counterparts of the operators that SQL can express."""

from __future__ import annotations

SUBSTRINGS = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents),
g as (select doc_id, unnest(range(len(words) - 19)) as s, words from w where len(words) >= 20),
k as (select doc_id, s, sha256(array_to_string(words[s + 1:s + 20], ' ')) as h from g),
f as (select *, row_number() over (partition by h order by doc_id, s) as nth from k),
c as (select distinct doc_id, s + unnest(range(20)) as i from f where nth > 1),
x as (select w.doc_id, len(words) as n_words, words, coalesce(list(i) filter (where i is not null), []) as gone from w left join c on w.doc_id = c.doc_id group by all)
select doc_id, cast(n_words as bigint) as n_words, cast(len(gone) as bigint) as n_removed,
sha256(array_to_string(case when len(gone) = 0 then words else list_filter(words, lambda v, j: not list_contains(gone, j - 1)) end, ' ')) as kept_sha256 from x
"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
DECONTAMINATION = f"""
with b as (select item_id, regexp_extract_all({_LOWER}, {_WORDS}) as words from benchmark where text is not null),
n as (select item_id, words, least(10, len(words)) as n from b where len(words) > 0),
win as (select item_id, n, array_to_string(words[s + 1:s + n], ' ') as g from (select *, unnest(range(len(words) - n + 1)) as s from n)),
w as (select doc_id, coalesce(regexp_extract_all({_LOWER}, {_WORDS}), []) as words from documents),
d as (select doc_id, s, n, array_to_string(words[s + 1:s + n], ' ') as g from (select doc_id, words, n, unnest(range(len(words) - n + 1)) as s from w, (select distinct n from win))),
m as (select d.doc_id, d.s, d.n, win.item_id from d join win on d.g = win.g and d.n = win.n),
h as (select doc_id, count(distinct i) as n_hit from (select doc_id, s + unnest(range(n)) as i from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, cast(item_id as varchar) as item from m) group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join h on w.doc_id = h.doc_id left join t on w.doc_id = t.doc_id
"""
SHARDING = """
with tab as (select list(c order by b) as t from (select b, list_reduce(list_prepend(cast(b as bigint), range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(b))),
r as (select doc_id, coalesce(text, '') as text, strlen(coalesce(text, '')) + 8 as size from documents),
z as (select doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) as text_crc32 from r, tab),
p as (select *, coalesce(sum(size) over (order by doc_id, text_crc32, size rows between unbounded preceding and 1 preceding), 0) as ahead, sum(size) over () as whole from z),
q as (select *, cast(least(23, ((ahead + size // 2) * 24) // whole) as integer) as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot, cast(null as integer) as grown_shard from q
"""

HARD_NEGATIVES = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(x as double)) for x in embedding] as v
  from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
),
s as (
  select a.vec_id as anchor_id, a.label as own, r.vec_id, r.label, cast(list_dot_product(a.v, r.v) as bigint) as score
  from r a, r where a.vec_id % 50 = 0 and a.vec_id <> r.vec_id
),
p as (select anchor_id, own, vec_id, score from s where own = label qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, cast(row_number() over w as integer) as rank, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on p.anchor_id = s.anchor_id and s.label <> p.own and 100 * s.score between 50 * p.score and 95 * p.score
window w as (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id)
qualify row_number() over w <= 3
"""
