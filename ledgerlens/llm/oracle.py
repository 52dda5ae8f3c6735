"""DuckDB SQL for those queries that SQL can express."""

ORACLE = {
    "op1_url_filter": r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end r from pages),
h as (select page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) path from u),
j as (select *, case
  when (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from h)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end verdict from j""",
    "op2_exact_dedup": r"""
with n as (select doc_id, coalesce(length(text), 0) cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') t from documents),
g as (select t, count(*) n, arg_min(doc_id, (-cp, doc_id)) keep from n group by t)
select doc_id, keep keep_id, n group_size, doc_id = keep kept, sha256(n.t) text_sha256 from n join g on n.t = g.t""",
    "op4_decontaminate": r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bx as (select item_id, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from bw where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') s from bx),
sizes as (select distinct n from win),
dx as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, sizes where len(w) >= n),
hits as (select doc_id, i, dx.n, item_id from dx join win on dx.n = win.n and array_to_string(dx.w[i : i + dx.n - 1], ' ') = win.s),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) s from (select distinct doc_id, cast(item_id as varchar) x from hits) group by doc_id)
select dw.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join pos on dw.doc_id = pos.doc_id left join its on dw.doc_id = its.doc_id""",
    "op11_line_dedup": r"""
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select r, doc_id, unnest(ls) line, unnest(range(1, len(ls) + 1)) pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
s as (select key, max(doc_id) last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.*, s.last is not null and doc_id <> s.last lost from k left join s on k.key = s.key)
select doc_id, count(*)::bigint n_lines, count(*) filter (lost)::bigint n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) kept_sha256
from j group by r, doc_id""",
    "op13_source_divergence": r"""
with d as (select row_number() over () r, coalesce(text, '') text, coalesce(lang, '') lang, coalesce(source, '') source from documents),
t as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
k as (select lang, term, count(*) total from t group by lang, term having count(distinct r) >= 10),
l as (select lang, count(*) v, sum(total) n from k group by lang),
c as (select t.lang, source, t.term, count(*) n from t join k on t.lang = k.lang and t.term = k.term group by t.lang, source, t.term),
g as (select d.lang, d.source, coalesce(any_value(s.n), 0) n from d left join (select lang, source, sum(n) n from c group by lang, source) s on d.lang = s.lang and d.source = s.source group by d.lang, d.source),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) c, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) p, 1 + (1000000000::hugeint * (k.total + 2)) // (l.n + 2 * l.v) q
  from g join k on g.lang = k.lang join l on g.lang = l.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) x from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
u as (select g.lang, g.source, 'pair' part, h.source item, coalesce(x, 0)::bigint "value" from g join g h on g.lang = h.lang and g.source <> h.source left join s on s.lang = g.lang and s.source = g.source and s.item = h.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where c > 0 and p > q),
w as (select *, (row_number() over (partition by lang, source, part order by "value" desc, item))::int "rank" from u)
select lang, source, part, item, "value", "rank" from w where part = 'pair' or "rank" <= 10""",
}


def _centroid_sql(rounds: int = 3) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as (select r, min(struct_pack(d := list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, k := k)) m from v cross join c{i} group by r)""")
        if i < rounds:
            steps.append(f"""
s{i} as (select k, pos, sum(x)::bigint s, count(*) n from (select m.k k, unnest(e) x, unnest(range(1, 65)) pos from a{i} join v on a{i}.r = v.r) group by k, pos),
u{i} as (select k, list((s - ((s % n) + n) % n) // n order by pos) c from s{i} group by k),
c{i + 1} as (select c{i}.k, coalesce(u{i}.c, c{i}.c) c from c{i} left join u{i} on c{i}.k = u{i}.k)""")
    return f"""
with v as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select (row_number() over (order by sha256('1:' || vec_id::varchar)) - 1)::int k, e c from v qualify k < 16),{",".join(steps)}
select vec_id, m.k as "cluster", m.d distance, (sum(m.d) over (partition by m.k))::bigint cluster_inertia, (sum(m.d) over ())::bigint inertia,
  sha256(array_to_string(c, ',')) centroid_sha256
from a{rounds} join v on a{rounds}.r = v.r join c{rounds} on m.k = c{rounds}.k"""


ORACLE["op12_centroids"] = _centroid_sql()
