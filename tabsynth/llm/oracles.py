"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed: RFC 4648
SPACE = r"[\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
d as (select page_id, body, hex, array_to_string(list_transform(range(32), lambda i: substr('{ALPHABET}',
  (((('0x' || substr(hex, ((i // 8) * 10 + 1)::int, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31) + 1)::int, 1)), '') as digest from p),
f as (select *, min(page_id) over (partition by hex) as first from d)
select page_id, octet_length(encode(body))::bigint as payload_bytes, digest as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id != first then first end as refers_to from f"""

# units end at . ! ? , ; : before white space or at a line's end; chr(30) marks the cuts
OP2 = f"""with l as (select doc_id, text, string_split(regexp_replace(coalesce(text, ''), '([.!?,;:]{SPACE}|\\n[\\x20\\x09-\\x0D]*)', '\\1' || chr(30), 'g'), chr(30)) as parts from documents),
u as (select doc_id, unnest(parts) as part, unnest(range(len(parts))) as n from l),
k as (select *, sum(length(part)) over (partition by doc_id order by n) as stop, trim(regexp_replace({LOWER.format('part')}, '{SPACE}', ' ', 'g')) as norm, len(regexp_extract_all(part, '[^\\x20\\x09-\\x0D]+')) as words from u where part != ''),
w as (select *, list(norm) over near as norms, list(words) over near as sizes, least(row_number() over (partition by doc_id order by n), 8) as i from k where words > 0 window near as (partition by doc_id order by n rows between 7 preceding and 7 following)),
j as (select *, coalesce(list_max(list_filter(range(1, i + 1), lambda x: list_sum(sizes[x:i]) >= 8)), 1) as j from w),
m as (select *, coalesce(list_min(list_filter(range(i, len(sizes) + 1), lambda x: list_sum(sizes[j:x]) >= 8)), len(sizes)) as m from j),
r as (select doc_id, n, row_number() over (partition by case when words >= 8 then norm else (i - j) || chr(10) || array_to_string(norms[j:m], chr(10)) end order by doc_id, n) > 1 as gone from m),
f as (select k.doc_id, k.n, part, stop, coalesce(gone, false) as gone, k.n = max(k.n) over (partition by k.doc_id) as last from k left join r on k.doc_id = r.doc_id and k.n = r.n),
a as (select doc_id, coalesce(string_agg(part, '' order by n) filter (not gone), '') as clean, bool_or(gone and last) as cut, count(*) filter (gone) as n_removed,
  coalesce(string_agg((stop - length(part))::bigint || ':' || stop::bigint, ' ' order by n) filter (gone), '') as removed from f group by 1)
select l.doc_id, case when text is null then null when cut then regexp_replace(clean, '{SPACE}$', '') else coalesce(clean, '') end as text,
  coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed, '') as removed from l left join a using (doc_id)"""

COMPONENTS = """reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)"""

OP6 = f"""with recursive w as (select doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '{SPACE}'), lambda x: x != '') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from w),
n as (select w.doc_id, count(g) as n from w left join s using (doc_id) group by 1),
c as (select x.doc_id as a, y.doc_id as b, count(*) as o from s x join s y on x.g = y.g and x.doc_id != y.doc_id group by 1, 2),
link as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * o >= 80 * (p.n + q.n - o)),
{COMPONENTS}
select doc_id, n::bigint as n_shingles, least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as component_id from n"""

OP7 = f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where label is not null and embedding is not null),
u as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as s from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
link as (select x.vec_id as a, y.vec_id as b from u x join u y on x.label = y.label and x.vec_id != y.vec_id and x.s > 0 and y.s > 0 where list_dot_product(x.e, y.e) / (x.s * y.s) >= 0.93),
{COMPONENTS},
m as (select vec_id, (select count(*) from link where a = vec_id) as n, least(vec_id, coalesce((select min(b) from reach where a = vec_id), vec_id)) as c from embeddings)
select vec_id, n::bigint as n_links, c::bigint as component_id, vec_id = c as kept from m"""

# a CRC is folded over the bytes by its table, which follows from the polynomial (fixed: IEEE 802.3)
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, _: xor(c >> 1, (c & 1) * 3988292384)))"

OP10 = f"""with recursive d as (select doc_id, coalesce(text, '') as x, md5(doc_id::varchar) as m, hex(encode(coalesce(text, ''))) as h from documents),
j as (select doc_id, n, ('0x' || substr(m, 1, 15))::ubigint::uhugeint as k, -1::bigint as was, 0::bigint as ahead from d, (values (16), (17)) v(n)
  union all select doc_id, n, k, ahead, floor((ahead + 1) * (2147483648::double / ((k // 8589934592)::double + 1)))::bigint
  from (select doc_id, n, ahead, (k * 2862933555777941757::uhugeint + 1::uhugeint) % 18446744073709551616::uhugeint as k from j where ahead < n)),
s as (select doc_id, (max(was) filter (n = 16))::int as shard, (max(was) filter (n = 17))::int as grown_shard from j where ahead >= n group by 1),
t as (select {CRC_TABLE} as crc),
c as (select doc_id, (octet_length(encode(x)) + 1)::bigint as size, m,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32 from d, t)
select c.doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by ('0x' || substr(m, 17, 8))::bigint, c.doc_id) - 1 as slot, grown_shard from c join s using (doc_id)"""

_FIELD = "case when {0} is null then '-' else strlen({0}::varchar) || ':' || {0}::varchar end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, (i + 1)::int, 1))::bigint)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"

# n: nodes of all trees; s: sources' trees, top: the tree above them; f: the fold of each row's leaf
OP12 = f"""with recursive c as (select {CRC_TABLE} as crc),
d as (select doc_id, source, {_LEAF.format(text='text')} as leaf, case when {_CRC} % 2 = 0 then replace(text, chr(10), '') else text end as now, lang, n_chars from documents, c),
l as (select *, {_LEAF.format(text='now')} as found, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from d),
s as (select source, 0 as lvl, i, n, leaf as h from l
  union all select source, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from s where n > 1 group by source, lvl, i // 3, n),
r as (select source, h as subroot, lvl as depth, row_number() over (order by source nulls first) - 1 as place, count(*) over () as sources from s where n = 1),
top as (select 0 as lvl, place as i, sources as n, subroot as h from r
  union all select lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from top where n > 1 group by lvl, i // 3, n),
u as (select h as root, lvl as height from top where n = 1),
b as (select row_number() over () as id, l.*, subroot, depth, place, root, height from l join r on l.source is not distinct from r.source, u),
p as (select id, s.lvl, s.i, s.h, s.i = b.i // (3 ** s.lvl)::bigint as own from b join s on s.source is not distinct from b.source and s.n > 1 and s.i // 3 = b.i // (3 ** (s.lvl + 1))::bigint
  union all select id, b.depth + top.lvl, top.i, top.h, top.i = b.place // (3 ** top.lvl)::bigint from b join top on top.n > 1 and top.i // 3 = b.place // (3 ** (top.lvl + 1))::bigint),
q as (select id, sha256(coalesce(string_agg(h, '' order by lvl, i) filter (not own), '')) as proof from p group by 1),
runs as (select id, lvl, coalesce(string_agg(h, '' order by i) filter (i < o), '') as lefts, coalesce(string_agg(h, '' order by i) filter (i > o), '') as rights from (select *, max(i) filter (own) over (partition by id, lvl) as o from p) group by 1, 2),
f as (select id, 0 as lvl, found as h from b union all select f.id, f.lvl + 1, sha256(lefts || f.h || rights) from f join runs on runs.id = f.id and runs.lvl = f.lvl)
select doc_id, leaf, subroot, root, coalesce(proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = root as verified
from b left join q using (id) join f on f.id = b.id and f.lvl = depth + height"""

OP11 = f"""with d as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x != '') as w from d),
n as (select lang, sum(len(w))::bigint as n from w group by 1),
o as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, (values (1), (2), (3), (4)) v(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from o group by 1, 2, 3 having count(*) >= 30),
c as (select lang, phrase, k, f as a, string_split(phrase, ' ') as ws from f where k > 1),
cuts as (select c.lang, c.phrase, a, cut, x.f as l, y.f as r, 2000000::hugeint * a // (x.f + y.f) as score from (select *, unnest(range(1, k)) as cut from c) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(ws[1:cut], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(ws[cut + 1:c.k], ' ')),
best as (select lang, phrase, a, l, r, score::bigint as score from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, max(a) as f from (select lang, a, ws, m, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c)) group by 1, 2),
kept as (select best.* from best left join longer using (lang, phrase) where f is null or 100::hugeint * f < 80::hugeint * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000"""
