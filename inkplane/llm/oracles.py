"""SQL of what SQL can express of the operators, for an independent engine over whole tables."""

from __future__ import annotations

import string

_COMPONENTS = """way as (select a, b from link union select b, a from link), reach(node, r) as (select a, a from way union select w.b, reach.r from reach join way w on w.a = reach.node),
  comp as (select node, min(r) as component from reach group by node)"""

OP3 = f"""with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
  link as (select p.vec_id as a, q.vec_id as b from v p join v q on p.vec_id < q.vec_id and list_cosine_similarity(p.e, q.e) >= 0.95), {_COMPONENTS},
  n as (select a as vec_id, count(*) as n from way group by a)
  select e.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component, e.vec_id) as component_id, coalesce(component, e.vec_id) = e.vec_id as kept
  from embeddings e left join comp on node = e.vec_id left join n on n.vec_id = e.vec_id"""

OP5 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), g as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as i from d)),
  m as (select s, min(doc_id) as m from g group by s), bad as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from g join m using (s) where m < doc_id),
  isle as (select doc_id, i, sum(case when before is null or i - before > 50 then 1 else 0 end) over (partition by doc_id order by i) as k from bad),
  span as (select doc_id, min(i) as a, max(i) + 50 as b from isle group by doc_id, k), gap as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as p from span),
  piece as (select doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) as kept, sum(b - a) as n, count(*) as k, max(b) as last from gap join d using (doc_id) group by doc_id)
  select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(k, 0)::bigint as n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) as kept_sha256 from d left join piece using (doc_id)"""

OP9 = f"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w from documents),
  s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as sh from w),
  n as (select doc_id, count(*) as n from s group by doc_id), both_have as (select p.doc_id as a, q.doc_id as b, count(*) as c from s p join s q on p.sh = q.sh and p.doc_id < q.doc_id group by all),
  link as (select a, b from both_have join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 75 * (p.n + q.n - c)), {_COMPONENTS}
  select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component, d.doc_id) as component_id from documents d left join n using (doc_id) left join comp on node = d.doc_id"""


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

#: Words and base places of op2.
BASE_LICENSES = f"""with w as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
  p(p, label) as (values (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')),
  spot as (select doc_id, label, i - 1 as i from (select doc_id, w, p, label, unnest(range(1, len(w) - len(p) + 2)) as i from w, p) where w[i : i + len(p) - 1] = p),
  n as (select doc_id, count(*) as n, min(i) as a, max(i) as b, string_agg(distinct label, ',' order by label) as labels from spot group by doc_id)
  select w.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, coalesce(a, -1)::bigint as first_word, coalesce(b, -1)::bigint as last_word, coalesce(labels, '') as base_labels from w left join n using (doc_id)"""

#: Host, path and rule of op4.
URL_RULES = f"""with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
  h as (select page_id, regexp_extract(rest, '^[^/?#]*') as h, rest from u),
  d as (select page_id, translate(h, '{string.ascii_uppercase}', '{string.ascii_lowercase}') as host, regexp_extract(substr(rest, len(h) + 1), '^[^?#]*') as path from h),
  r(rh, rp, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
  m as (select page_id, max_by(rh || rp, len(rh || rp)) as rule, max_by(v, len(rh || rp)) as ruled from d join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
  select d.page_id, host, path, rule, ruled from d left join m using (page_id)"""

#: How many spans of the base kinds op8 finds.
PII_COUNTS = """with t as (select doc_id, coalesce(text, '') as t from documents),
  m as (select doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') as email, regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') as ip,
    regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+') as card, regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]') as phone from t),
  d as (select doc_id, email, list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: len(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as int), 0) > 255)) = 0) as ip,
    list_transform(card, lambda x: list_transform(range(1, len(regexp_replace(x, '[^0-9]', '', 'g')) + 1), lambda i: substr(reverse(regexp_replace(x, '[^0-9]', '', 'g')), i, 1)::int * (2 - i % 2))) as card,
    list_filter(phone, lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) between 8 and 15) as phone from m)
  select doc_id, len(email)::bigint as n_email, len(ip)::bigint as n_ip, len(list_filter(card, lambda c: len(c) between 16 and 19 and list_sum(list_transform(c, lambda v: v // 10 + v % 10)) % 10 = 0))::bigint as n_card, len(phone)::bigint as n_phone from d"""

#: Sizes, and targets by water filling: the excess of sources at their cap is reshared until none is above.
MIX_TARGETS = """with recursive s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
  t as (select source, sum(size)::double as total, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from s group by source),
  f(k, caps) as (select 0, list({'source': source, 'total': total, 'w': w, 'full': false}) from t
    union all
    select k + 1, list_transform(caps, lambda c: {'source': c.source, 'total': c.total, 'w': c.w, 'full': c.full or c.w * level > 2 * c.total})
    from (select k, caps, (1.5 * list_sum(list_transform(caps, lambda c: c.total)) - list_sum(list_transform(caps, lambda c: case when c.full then 2 * c.total else 0 end)))
      / nullif(list_sum(list_transform(caps, lambda c: case when c.full then 0 else c.w end)), 0) as level from f) where len(list_filter(caps, lambda c: not c.full and c.w * level > 2 * c.total)) > 0),
  e as (select caps, (1.5 * list_sum(list_transform(caps, lambda c: c.total)) - list_sum(list_transform(caps, lambda c: case when c.full then 2 * c.total else 0 end)))
      / nullif(list_sum(list_transform(caps, lambda c: case when c.full then 0 else c.w end)), 0) as level from f qualify row_number() over (order by k desc) = 1),
  g as (select c.source as source, c.total::bigint as source_size, case when c.full then 2 * c.total else c.w * level end as target from (select unnest(caps) as c, level from e))
  select doc_id, size, source_size, round(target, 3) as target from s join g on s.source is not distinct from g.source"""
