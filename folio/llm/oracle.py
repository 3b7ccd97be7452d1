"""SQL that gives the rows of those queries that SQL can express on whole tables, in another engine and by another way: all pairs."""

from __future__ import annotations

EMBEDDING_DEDUP = r"""with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, c) as (select a, a from l union select r.id, l.b from r join l on l.a = r.c),
m as (select id, min(c) as c from r group by id), n as (select a, count(*) as n from l group by a)
select d.vec_id, coalesce(n.n, 0) as n_links, coalesce(m.c, d.vec_id) as component_id, coalesce(m.c, d.vec_id) = d.vec_id as kept from embeddings d left join n on n.a = d.vec_id left join m on m.id = d.vec_id"""

MINHASH_DEDUP = r"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as a from documents),
s as materialized (select distinct doc_id, array_to_string(a[g:least(g + 4, len(a))], ' ') as s from w, unnest(range(1, greatest(len(a) - 4, case when len(a) > 0 then 1 else 0 end) + 1)) u(g)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
l as materialized (select x.doc_id as a, y.doc_id as b from s x join s y on x.s = y.s and x.doc_id < y.doc_id join n p on p.doc_id = x.doc_id join n q on q.doc_id = y.doc_id group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 75 * (p.n + q.n - count(*))),
e as materialized (select a, b from l union all select b, a from l),
r(id, c) as (select a, a from e union select r.id, e.b from r join e on e.a = r.c),
m as (select id, min(c) as c from r group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.c, d.doc_id) as component_id, coalesce(m.c, d.doc_id) = d.doc_id as kept from documents d left join n using (doc_id) left join m on m.id = d.doc_id"""

SUBSTRING_DEDUP = r"""with w as materialized (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as a from documents),
g as materialized (select doc_id, k, sha256(array_to_string(a[k:k + 34], ' ')) as h from w, unnest(range(1, len(a) - 33)) u(k)),
r as (select h from g group by h having count(*) > 1),
c as materialized (select distinct doc_id, i from g join r using (h), unnest(range(k, k + 35)) v(i)),
t as (select w.doc_id, i, a[i] as word from w, unnest(range(1, len(a) + 1)) u(i)),
k as (select t.doc_id, string_agg(word, ' ' order by t.i) as kept, count(*) as n from t anti join c on c.doc_id = t.doc_id and c.i = t.i group by t.doc_id)
select w.doc_id, cast(len(a) as bigint) as n_words, cast(len(a) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from w left join k using (doc_id)"""

ORACLE = {"op4_embedding_dedup": EMBEDDING_DEDUP, "op6_minhash_dedup": MINHASH_DEDUP, "op7_substring_dedup": SUBSTRING_DEDUP}
