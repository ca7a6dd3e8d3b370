"""DuckDB SQL for the queries that SQL can express."""

SQL = {}

SQL["op3_url_filter"] = r"""
with u as (
  select page_id, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), k as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), r(verdict, rhost, rpath) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')
), m as (
  select page_id, host, path, rhost || rpath as rule, verdict,
    row_number() over (partition by page_id order by length(rhost || rpath) desc nulls last) as nth
  from k left join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where nth = 1
"""

_TREE = r"list_transform(regexp_extract_all({0}, '(?s).{{1,120}}?(?:\n|[.!?,;|] |[、。！，？；]|\z)|.{{32,119}}? |.{{120}}'), lambda p: md5(p))"
_SECTIONS = "list_transform(string_split(array_to_string(list_transform({0}, lambda h: case when h < '4' then h || '.' else h end), ''), '.'), lambda s: md5(s))"
_PRINT = (
    "md5(array_to_string(t{0}, ''))"
    " || ':' || array_to_string(list_transform({0}, lambda h: case when h < '4' then substr(h, 1, 8) || '.' else substr(h, 1, 8) end), '')"
)
_NEAR = "case when len(sa) + len({0}) = 0 then 1.0 else len(list_intersect(sa, {0}))::double / (len(sa) + len({0}) - len(list_intersect(sa, {0}))) end"
SQL["op8_fingerprints"] = f"""
with d as (
  select doc_id, coalesce(text, '') as text,
    coalesce(lead(coalesce(text, '')) over (order by doc_id desc), first_value(coalesce(text, '')) over (order by doc_id desc)) as next_text from documents
), e as (
  select *, substr(text, 1, length(text) - length(text) // 3) || substr(next_text, 1, length(text) // 3) as edited from d
), t as (
  select doc_id, length(text) as n_chars, sha256(edited) as edited_sha256, {_TREE.format("text")} as a, {_TREE.format("edited")} as b, {_TREE.format("next_text")} as c from e
), s as (
  select *, list_distinct(list_transform(a, lambda h: substr(h, 1, 8))) as sa, list_distinct(list_transform(b, lambda h: substr(h, 1, 8))) as sb,
    list_distinct(list_transform(c, lambda h: substr(h, 1, 8))) as sc, {_SECTIONS.format("a")} as ta, {_SECTIONS.format("b")} as tb from t
)
select doc_id, n_chars, edited_sha256, {_PRINT.format("a")} as fingerprint, {_PRINT.format("b")} as edited_fingerprint,
  {_NEAR.format("sb")} as near_edited, {_NEAR.format("sc")} as near_next,
  array_to_string(list_filter(list_transform(ta, lambda h, i: case when not list_contains(tb, h) then i - 1 end), lambda i: i is not null), ',') as edited_sections from s
"""

SQL["op7_substring_dedup"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), s as (select doc_id, unnest(range(1, len(w) - 18)) as s from w
), h as (select s.doc_id, s.s, md5(array_to_string(w.w[s.s : s.s + 19], ' ')) as h from s join w using (doc_id)
), n as (select doc_id, s, row_number() over (partition by h order by doc_id, s) as nth from h
), g as (select distinct doc_id, unnest(range(s, s + 20)) as i from n where nth > 1
), r as (select doc_id, list(i) as gone from g group by doc_id
), k as (select w.doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
    case when gone is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)), lambda i: w[i]) end as kept
  from w left join r using (doc_id))
select doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256 from k
"""

SQL["op10_jaccard_join"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) end as s from w
), t as (select doc_id, len(s) as n, unnest(s) as g from s
), c as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as shared from t a join t b on a.g = b.g and a.doc_id <> b.doc_id group by all
), l as (select a, b from c where 100 * shared >= 85 * (na + nb - shared)
), r as (select doc_id as node, doc_id as root from documents union select l.b, r.root from r join l on l.a = r.node where r.root < l.b)
select s.doc_id, len(s) as n_shingles, (select min(root) from r where r.node = s.doc_id) as component_id from s
"""

SQL["op2_embedding_dedup"] = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), n as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e from v
), l as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) >= 0.98
), r as (select vec_id as node, vec_id as root from embeddings union select l.b, r.root from r join l on l.a = r.node where r.root < l.b
), c as (select node, min(root) as root from r group by node
), k as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n, 0) as n_links, root as component_id, vec_id = root as kept
from embeddings join c on c.node = vec_id left join k on k.a = vec_id
"""

SQL["op12_lexical_search"] = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark
), c as (select count(*) as n_docs, sum(len(w))::bigint as total from d where len(w) > 0
), q as (select item_id, t, count(*) as times from (select item_id, unnest(w) as t from b) group by all
), f as (select doc_id, t, count(*) as tf, any_value(n) as n from (select doc_id, len(w) as n, unnest(w) as t from d) where t in (select t from q) group by doc_id, t
), v as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from f, c group by t, n_docs
), s as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::bigint as score from q join v using (t) join f using (t), c group by all
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""
