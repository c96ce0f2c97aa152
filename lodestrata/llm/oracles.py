"""DuckDB SQL for the queries of ``lodestrata.llm.queries`` that SQL can express."""

from . import secrets

_CLASS = "length(size::varchar) * 100 + substr(size::varchar, 1, 2)::int"

OP1 = f"""
with d as (
  select doc_id, text, case when source is null then '1' else '0' || source end as k,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('mix-1|' || coalesce(doc_id::varchar, 'null')) as h
  from documents
), s as (select k, sum(size)::bigint as source_size from d group by k),
w as (select *, (row_number() over (order by k) - 1) % 3 + 1 as w, 3 * source_size as cap from s),
o as (
  select *, coalesce(sum(cap) over (order by cap::double / w, k rows between unbounded preceding and 1 preceding), 0)::bigint as cap_before,
         coalesce(sum(w) over (order by cap::double / w, k rows between unbounded preceding and 1 preceding), 0)::bigint as w_before,
         (sum(source_size) over ())::bigint as total, (sum(w) over ())::bigint as weights
  from w
), f as (select *, cap <= w * ((total - cap_before)::double / (weights - w_before)) as is_full from o),
g as (
  select *, (sum(case when is_full then 0 else w end) over ())::bigint as rest,
         (sum(case when is_full then cap else 0 end) over ())::bigint as capped
  from f
), t as (
  select k, source_size, case when is_full then cap::double else w * ((total - capped)::double / nullif(rest, 0)) end as target,
         ('0x' || substr(md5('mix-1|offset|' || k), 1, 8))::bigint / 4294967296.0::double as start
  from g
), p as (
  select d.*, source_size, target, start, case when source_size > 0 then target / source_size else 0 end as rate,
         row_number() over (partition by d.k order by {_CLASS}, h, size) as i
  from d join t using (k)
)
select doc_id, size, source_size, target,
       (size * greatest(0, least(3, floor(rate * i + start) - floor(rate * (i - 1) + start))))::bigint as taken
from p
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
with d as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents
), t as (select i, lang, source, unnest(terms) as term from d),
kept as (select lang, term, count(*) as lang_count from t group by lang, term having count(distinct i) >= 30),
v as (select lang, count(*) as v, sum(lang_count) as n from kept group by lang),
groups as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by lang, source, term),
totals as (select g.lang, g.source, coalesce(sum(n), 0) as total from groups g left join c using (lang, source) group by 1, 2),
cells as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::hugeint) // (total + 5 * v)::hugeint as p,
         1 + (1000000000 * (lang_count + 5)::hugeint) // (v.n + 5 * v)::hugeint as q
  from totals g join v using (lang) join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), pairs as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
), found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, (p - q)::bigint from cells where n > 0 and p > q
), ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found)
select * from ranked where part = 'pair' or rank <= 50
"""

# CRC32, bit by bit; only the distinct words are hashed
_BIT = "case when {0} % 2 = 1 then xor({0} >> 1, 3988292384) else {0} >> 1 end"
_BYTE = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: " + _BIT.format("x") + ")"

OP12 = f"""
with d as (
  select row_number() over () as i, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents
), w as (select i, unnest(words) as word from d),
goal as (select unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from benchmark),
bytes as (
  select word, list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::bigint) as b
  from (select word from w union select word from goal)
), buckets as (select word, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, b: {_BYTE}), 4294967295) % 10000 as bucket from bytes),
s as (select bucket, count(*) as s from w join buckets using (word) group by 1),
t as (select bucket, count(*) as t from goal join buckets using (word) group by 1),
gain as (
  select b as bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((select count(*) from w) + 10000))::double / ((coalesce(s, 0) + 1) * ((select count(*) from goal) + 10000))::double))::bigint as gain
  from range(10000) r(b) left join s on s.bucket = b left join t on t.bucket = b
), weights as (select i, sum(gain)::bigint as weight from w join buckets using (word) join gain using (bucket) group by 1),
scored as (
  select i, doc_id, len(words) as n_features, coalesce(weight, 0)::bigint as weight,
         coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from d left join weights using (i)
), ranked as (
  select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as r,
         (select count(*) * 10 // 100 from d where len(words) >= 20) as most
  from scored
)
select doc_id, n_features::bigint as n_features, weight, score, case when r <= most then r end as rank from ranked
"""

_SECRET_PATTERNS = {k: p.replace("'", "''") for k, p in {**secrets.PATTERNS, "break": secrets.BREAK}.items()}
_CUT = " union all ".join(
    f"select r, '{kind}' as kind, unnest(p) as piece, generate_subscripts(p, 1) as i from (select r, string_split(regexp_replace(text, '{p}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) as p from d)" for kind, p in _SECRET_PATTERNS.items()
)
_KINDS = "['" + "', '".join(secrets.PATTERNS) + "']"
_NEAR = f"between 0 and {secrets.REACH}"

# positions are running sums over what is between matches; every part is compared with every other of its scope
OP13 = f"""
with d as (select row_number() over () as r, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) as text from documents),
c as ({_CUT}),
p as (
  select r, kind, e - length(piece) as s, e from (select *, sum(length(piece)) over (partition by r, kind order by i)::bigint as e from c)
  where i % 2 = 0 and (kind <> 'assign' or length(regexp_extract(piece, '{_SECRET_PATTERNS["assign"]}', 2)) >= {secrets.LEAST_VALUE})
    and (kind <> 'key' or length(piece) = 40 and not contains(piece, '=') and regexp_matches(piece, '[a-z]') and regexp_matches(piece, '[A-Z]') and regexp_matches(piece, '[0-9]'))
), q as (select *, count(case when kind = 'break' then 1 end) over (partition by r order by s) as scope from p),
a as (select * from q where kind in {secrets.IDENTIFIERS}), b as (select * from q where kind in {secrets.SECRETS}), h as (select * from q where kind = 'endpoint'),
pairs as (select r, scope, a.kind as ak, a.s as a_s, a.e as ae, b.kind as bk, b.s as bs, b.e as be from a join b using (r, scope) where greatest(a.s, b.s) - least(a.e, b.e) {_NEAR}),
tied as (select r, scope, ak as kind, a_s as s, ae as e from pairs union select r, scope, bk, bs, be from pairs),
ends as (select t.r, t.kind, t.s, t.e, h.s as hs, h.e as he from tied t join h using (r, scope) where greatest(t.s, h.s) - least(t.e, h.e) {_NEAR}),
told as (
  select r, kind, s, e from q where kind in {secrets.STRONG} union select r, kind, s, e from tied where kind in {secrets.WEAK} union select r, 'endpoint', hs, he from ends
), spans as (
  select r, string_agg(kind || ':' || s || ':' || e, ',' order by s, list_position({_KINDS}, kind), e) as spans,
         string_agg(case when kind in {secrets.STRONG} then kind || ':' || s || ':' || e end, ',' order by s, list_position({_KINDS}, kind)) as base,
         count(case when kind = 'assign' then 1 end) as n_assign, count(case when kind = 'access' then 1 end) as n_access, count(case when kind = 'hex' then 1 end) as n_hex
  from told group by r
), n as (select r, count(*) as n from (select r from pairs union all select r from ends) group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n, 0)::bigint as n_links
from d left join spans using (r) left join n using (r)
"""

ORACLES = {"op13_secrets": OP13, "op1_mixing": OP1, "op11_divergence": OP11, "op12_resampling": OP12}
