"""DuckDB SQL of the llm queries that SQL can express over whole tables."""

from __future__ import annotations

#: Bare upper-case base32 of a hexadecimal SHA-1 ``d``: five hexadecimal digits are four signs.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)"
    for i in range(8) for s in (15, 10, 5, 0))

OP13 = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as d from pages),
r as (select *, row_number() over (partition by d order by page_id nulls last) as nth,
             first_value(page_id) over (partition by d order by page_id nulls last) as best from p)
select page_id, payload_bytes, {_BASE32} as payload_digest,
       case when nth = 1 then 'response' else 'revisit' end as record_type, case when nth > 1 then best end as refers_to
from r
"""

#: CRC-32 of the decimal digits of ``c``, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    range(1, length(c::VARCHAR) + 1), lambda i: [512 + ascii(substr(c::VARCHAR, i::INT, 1)), 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: CASE WHEN x >= 512 THEN xor(a, x - 512) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

OP12 = f"""
with named as (select conv_id as c, turn, length(coalesce(text, ''))::BIGINT as n,
        sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) as name
    from conversations where conv_id is not null),
t as (select c, n, name, row_number() over (partition by c order by turn nulls first, name) as pos from named),
ids as (select c, max(pos) as own from t group by c),
h as (select c, own, c - c % 100 as donor, {_CRC} % 6 as h from ids),
k as (select h.c, h.own, h.h, h.donor, least(h.h, coalesce(d.own, 0)) as k from h left join ids d on d.c = h.donor),
turns as (select k.c, t.pos, t.name, t.n from k join t on t.c = k.donor and t.pos <= k.k
          union all select k.c, t.pos - k.h + k.k, t.name, t.n from k join t on t.c = k.c and t.pos > k.h),
lists as (select c, list(name order by pos) as names, list(n order by pos) as ns from turns group by c),
convs as (select k.c, coalesce(names, []) as names, coalesce(ns, []) as ns from k left join lists using (c)),
steps as (select c, names, ns, unnest(range(0, len(names) + 1)) as d from convs),
members as (select c, d, md5(names[1:d]::VARCHAR) as key, case when d > 0 then md5(names[1:d - 1]::VARCHAR) end as parent,
                   case when d > 0 then ns[d] else 0 end as n, len(names) = d as ends from steps),
nodes as (select key, d, min(parent) as parent, min(c) as conv_id, count(*) as n_convs, max(n) as n,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' order by c) filter (where ends), '')) as ends_sha256
          from members group by key, d),
kids as (select parent, count(*) as n_children from nodes where parent is not null group by parent),
weighed as (select nodes.*, coalesce(n_children, 0) as n_children, up.conv_id as parent_conv_id
            from nodes left join kids on kids.parent = nodes.key and nodes.d >= 0 left join nodes up on up.key = nodes.parent and up.d = nodes.d - 1),
sums as (select m.key, m.d, sum(case when w.n_children = 0 then 1 else 0 end) as n_leaves, sum((w.n_convs - 1) * w.n) as saved
         from weighed w join members m on m.c = w.conv_id and m.d <= w.d group by m.key, m.d)
select conv_id, d::BIGINT as depth, parent_conv_id, n_convs::BIGINT as n_convs, n_children::BIGINT as n_children,
       n_leaves::BIGINT as n_leaves, saved::BIGINT as saved_tokens, ends_sha256
from weighed join sums using (key, d)
"""

OP11 = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  coalesce(text, '') as text from documents),
w as (select id, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct id) >= 3),
v as (select lang, count(*) as v from kept group by lang),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by lang, source, term),
g as (select lang, source, coalesce(sum(n), 0)::HUGEINT as total, any_value(coalesce(v, 0)) as v
      from (select distinct lang, source from d) left join c using (lang, source) left join v using (lang) group by lang, source),
p as (select g.lang, g.source, kept.term, coalesce(n, 0) as n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) as p
      from g join kept using (lang) left join c using (lang, source, term)),
q as (select lang, term, 1 + 1000000000::HUGEINT * (lang_n + 1) // (sum(lang_n) over (partition by lang) + count(*) over (partition by lang)) as q
      from (select lang, term, sum(n)::HUGEINT as lang_n from c group by lang, term)),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source
          left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
                     from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x
          on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value
          from p join q using (lang, term) where n > 0 and p > q),
both_parts as (select * from pairs union all select * from terms)
select lang, source, part, item, value::BIGINT as value, r::INT as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as r from both_parts)
where part = 'pair' or r <= 200
"""

ORACLES: dict[str, str] = {"op11_divergence": OP11, "op12_trie": OP12, "op13_warc": OP13}
