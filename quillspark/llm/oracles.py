"""SQL of the operators that learn nothing SQL cannot: the same rows from the same tables."""

RESAMPLE_SQL = r"""
with crc as materialized (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from (select cast(range as bigint) as i from range(256))
), texts as (
  select 'd' as k, doc_id as id, text from documents union all select 'b', item_id, text from benchmark
), words as materialized (
  select k, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w
  from texts where text is not null
), distinct_words as (
  select w, hex(encode(w)) as h from (select distinct w from words)
), buckets as materialized (
  select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as b
  from distinct_words, crc
), counts as (
  select b, count(*) filter (k = 'd') as s, count(*) filter (k = 'b') as t from words join buckets using (w) group by b
), totals as (
  select sum(s) as bs, sum(t) as bt from counts
), gains as materialized (
  select b, cast(floor(1000 * ln((cast(t + 1 as double) * cast(bs + 10000 as double)) / (cast(s + 1 as double) * cast(bt + 10000 as double)))) as bigint) as g from counts, totals
), weighed as (
  select id, count(*) as n, sum(g) as weight from words join buckets using (w) join gains using (b) where k = 'd' group by id
), scored as (
  select doc_id, coalesce(n, 0) as n, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((cast(cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) as double) + 0.5) / 4294967296.0))) as score
  from documents left join weighed on doc_id = id
), drawn as (
  select doc_id, row_number() over (order by score desc, doc_id) as r from scored where n >= 20
)
select s.doc_id, cast(n as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
  cast(case when r <= (select 10 * count(*) // 100 from drawn) then r end as bigint) as rank
from scored s left join drawn d on s.doc_id = d.doc_id
"""

URL_FILTER_SQL = r"""
with named as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages
), rules(rh, rp, v) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits as (
  select page_id, arg_max(struct_pack(r := rh || rp, v := v), length(rh || rp)) as f
  from named join rules on ('.' || host) like ('%.' || rh) and starts_with(path, rp) group by page_id
), marks as (
  select doc_id, max(cast(quality = 0 or toxic = 1 as int)) as bad from labels group by doc_id
), hosts as (
  select host, array_to_string(string_split(host, '.')[-1:], '.') as suffix, array_to_string(string_split(host, '.')[-2:], '.') as domain,
    cast(count(*) as double) as n, cast(sum(bad) as double) as k
  from named join marks on try_cast(regexp_extract(path, '^/[A-Za-z]+/([0-9]+)', 1) as bigint) = doc_id where host <> '' group by host
), base as (
  select (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) as m from hosts
), s0 as (
  select suffix, sum(n) as n, sum(k) as k, any_value(m) as m from hosts, base group by suffix
), sm as (
  select 1 / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.25) - 1 as z from s0
), s1 as (
  select suffix, (m * z + k) / (z + n) as post, z + n as w from s0, sm
), d0 as (
  select suffix, domain, sum(n) as n, sum(k) as k, any_value(post) as m from hosts join s1 using (suffix) group by suffix, domain
), dm as (
  select 1 / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.25) - 1 as z from d0
), d1 as (
  select domain, (m * z + k) / (z + n) as post, z + n as w from d0, dm
), h0 as (
  select host, n, k, post as m from hosts join d1 using (domain)
), hm as (
  select 1 / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.25) - 1 as z from h0
), h1 as (
  select host, (m * z + k) / (z + n) as post, z + n as w from h0, hm
), rated as (
  select page_id, host, path, coalesce(h1.post, d1.post, s1.post) as p, coalesce(h1.w, d1.w, s1.w) as w
  from named left join h1 using (host)
  left join d1 on d1.domain = array_to_string(string_split(host, '.')[-2:], '.')
  left join s1 on s1.suffix = array_to_string(string_split(host, '.')[-1:], '.')
)
select page_id, host, path, f.r as rule, coalesce(f.v, case when coalesce(p - 1.645 * sqrt(p * (1 - p) / (w + 1)), 0) > 0.5 then 'block' else 'allow' end) as verdict
from rated left join fits using (page_id)
"""

DIVERGENCE_SQL = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), occurrences as (
  select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as materialized (
  select lang, term, count(*) as n from occurrences group by lang, term having count(distinct id) >= 30
), langs as (
  select lang, count(*) as v, sum(n) as total from kept group by lang
), groups as materialized (
  select distinct lang, source from docs
), counts as (
  select lang, source, term, count(*) as c from occurrences join kept using (lang, term) group by all
), totals as (
  select lang, source, sum(c) as total from counts group by all
), shares as materialized (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c,
    cast(1 + (1000000000::hugeint * (coalesce(c.c, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) as bigint) as p,
    cast(1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v) as bigint) as q
  from groups g join kept k using (lang) join langs l using (lang)
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
  left join totals t on t.lang = g.lang and t.source = g.source
), sums as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), found as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, p - q from shares where c > 0 and p > q
), ranked as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from found
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
