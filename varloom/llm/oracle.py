"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import licenses
from . import secretscan as s

REACH = """reach(v, c) as (select id, id from nodes union select l.b, r.c from reach r join both_ways l on l.a = r.v),
 comp as (select v as id, min(c) as component_id from reach group by v)"""


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP3 = """with v as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256.0::double * x::double)::bigint) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 p as (select a.row, a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
 r as (select *, row_number() over (partition by row order by score desc, vec_id)::int as rank from p)
 select query_id, rank, vec_id, score from r where rank <= 5"""

OP5 = f"""with recursive v as (select vec_id as id, label, list_transform(embedding, lambda x: x::double) as x from embeddings
  where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 both_ways as materialized (select a.id as a, b.id as b from v a join v b on a.label = b.label and a.id <> b.id
  where list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98),
 nodes as (select vec_id as id from embeddings), {REACH},
 d as (select a, count(*) as n from both_ways group by a)
 select id as vec_id, coalesce(n, 0)::bigint as n_links, component_id, id = component_id as kept from comp left join d on a = id"""

OP6 = rf"""with recursive w as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 g as materialized (select id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
 e as materialized (select id, len(s) as n, unnest(s) as t from g),
 c as (select x.id as a, y.id as b, x.n as n, y.n as m, count(*) as k from e x join e y on x.t = y.t and x.id <> y.id group by all),
 both_ways as materialized (select a, b from c where 100 * k >= 75 * (n + m - k)),
 nodes as (select doc_id as id from documents), {REACH}
 select g.id as doc_id, len(s)::bigint as n_shingles, component_id from g join comp on comp.id = g.id"""


def op8() -> str:
    known = "MAP {" + ", ".join(f"{_text(v)}: '{k:02d}'" for k, v in licenses.SENTENCES.items()) + "}"
    line = lambda seq: "".join(f"{i:02d}," for i in seq)
    named = "MAP {" + ", ".join(f"'{line(q)}': '{n}'" for q, n in licenses.RULES) + "}"
    rule = "|".join(line(q) for q, _ in licenses.RULES)
    return rf"""with a as (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?:;]+(?:\s+|$)|\n+'),
   lambda x: {known}[trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))]), lambda x: x is not null) as ids from documents)
 select doc_id, len(ids)::bigint as n_sentences, coalesce(array_to_string(ids, ','), '') as sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(array_to_string(ids, ',') || ',', '({rule})', 1), lambda m: {named}[m]))), ','), '') as licenses from a"""


def op9() -> str:
    kinds = {"assign": (s.ASSIGN, rf"length(regexp_extract(f[i], {_text(s.ASSIGN)}, 2)) >= 6"), "access": (s.ACCESS, "true"), "hex": (s.HEX, "true"),
             "name": (s.NAME, "true"), "bare": (s.BARE, "length(f[i]) <= 128 and regexp_matches(f[i], '[0-9]') and regexp_matches(f[i], '[a-z]') and regexp_matches(f[i], '[A-Z]')"),
             "endpoint": (s.ENDPOINT, "true")}
    parts = []
    for n, kind in enumerate(s.KINDS):
        pattern, keep = kinds[kind]
        parts.append(rf"""select rid, {n} as k, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::bigint as s,
  length(f[i]) as n from (select rid, f, string_split_regex(t, {_text(pattern)}) as g, unnest(range(1, len(f) + 1)) as i from (select rid, t, regexp_extract_all(t, {_text(pattern)}) as f from d)) where {keep}""")
    role = lambda c: f"case when {c} in (1, 3) then 'i' when {c} in (0, 2, 4) then 's' else 'p' end"
    names = "[" + ", ".join(_text(k) for k in s.KINDS) + "]"
    text = f"string_agg({names}[k + 1] || ':' || s || ':' || e, ',' order by s, k, e)"
    return rf"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
 p as materialized (select rid, k, s, s + n as e from ({' union all '.join(parts)})),
 q as (select a.rid, a.k, a.s, a.e, max(({role('b.k')} = 'i')::int) as i, max(({role('b.k')} = 's')::int) as x, max(({role('b.k')} = 'p')::int) as y
  from p a join p b on a.rid = b.rid and b.s <= a.e + {s.SCOPE} and a.s <= b.e + {s.SCOPE} and {role('a.k')} <> {role('b.k')} where a.k >= 3 group by all),
 w as (select rid, k, s, e from q where (k = 3 and x = 1) or (k = 4 and (i = 1 or y = 1)) or (k = 5 and i = 1 and x = 1)),
 z as (select * from p where k < 3 union all select * from w),
 y as (select rid, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, {text} filter (k < 3) as base, {text} as spans from z group by rid)
 select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
 from d left join y on d.rid = y.rid"""


_BITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * g + 1}, 5))::int >> {b} & 31) + 1, 1)" for g in range(8) for b in (15, 10, 5, 0))
OP10 = f"""with p as (select page_id, coalesce(html, '') as h0 from pages), q as (select page_id, strlen(h0)::bigint as payload_bytes, sha1(h0) as h from p),
 r as (select *, min(page_id) over (partition by h) as first from q)
 select page_id, payload_bytes, {_BITS} as payload_digest, case when first is null or first is not distinct from page_id then 'response' else 'revisit' end as record_type,
 case when first is not distinct from page_id then null else first end as refers_to from r"""


_CRC = """xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
   lambda a, b: list_reduce([xor(a, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
OP11 = rf"""with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, {_CRC} as h from documents),
 e as (select rid, doc_id, w, len(w) as n, coalesce(h % 10 = 0 and len(w) > 0, false) as cut, case when len(w) > 0 then (h // 10) % len(w) end as a, h // 10 as g from d),
 f as materialized (select rid, doc_id, n, case when cut then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end as w from e),
 t as materialized (select rid, n, unnest(range(n)) as i, unnest(w) as w from f),
 p as (select x.rid, x.i, y.i - x.i as q from t x join t y on x.rid = y.rid and x.w = y.w and y.i > x.i where 4 * (y.i - x.i) <= x.n),
 s as (select rid, q, i - row_number() over (partition by rid, q order by i) as part, i from p),
 c as materialized (select rid, q, min(i) as s, count(*) + q as n from s group by rid, q, part having count(*) + q >= greatest(6, 4 * q)),
 r as materialized (select * from c where not exists (select 1 from c b where b.rid = c.rid and b.q < c.q and b.s <= c.s and b.s + b.n >= c.s + c.n)),
 best as (select * from r qualify row_number() over (partition by rid order by (n::hugeint * 1000000000000) // q desc, s, q) = 1),
 line as (select rid, count(*) as n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) as runs from r group by rid),
 gone as (select distinct rid, unnest(range(s + q, s + n)) as i from r),
 kept as (select t.rid, string_agg(w, ' ' order by t.i) as w from t anti join gone using (rid, i) group by t.rid)
 select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.n::bigint as length, best.q::bigint as period, (1000 * best.n // best.q)::bigint as exponent_milli,
  sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept.w, '')) as collapsed_sha256
 from f left join line using (rid) left join best using (rid) left join kept using (rid)"""

OP13 = r"""with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
 w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
 t as (select lang, sum(len(w))::bigint as n from w group by lang),
 g as (select lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda m: list_transform(range(1, greatest(len(w) - m + 2, 1)), lambda i: {'m': m, 'x': array_to_string(w[i:i + m - 1], ' ')})))) as g from w),
 f as materialized (select lang, g.x as phrase, g.m as m, count(*) as f from g group by all having count(*) >= 30),
 c as (select lang, phrase, m, f as a, string_split(phrase, ' ') as w from f where m > 1),
 k as (select lang, phrase, m, a, w, unnest(range(1, m)) as k from c),
 s as (select k.lang, k.phrase, k.a, k.k, l.f as l, r.f as r, (2000000::hugeint * k.a) // (l.f + r.f) as score from k
  join f l on l.lang = k.lang and l.phrase = array_to_string(w[1:k], ' ') join f r on r.lang = k.lang and r.phrase = array_to_string(w[k + 1:], ' ')),
 b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
 i as (select lang, phrase, max(a) as longer from (select lang, a, unnest(flatten(list_transform(range(2, m), lambda j: list_transform(range(1, m - j + 2), lambda i: array_to_string(w[i:i + j - 1], ' '))))) as phrase from c where m > 2) group by all),
 o as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, encode(b.phrase)) as rank from b left join i on b.lang = i.lang and b.phrase = i.phrase where longer is null or 100 * longer < 80 * a)
 select o.lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from o join t on t.lang = o.lang where rank <= 2000"""


def sql() -> dict[str, str]:
    return {"op3_bit_sliced_topk": OP3, "op5_pca_tiles": OP5, "op6_jaccard_tsearch": OP6, "op8_license_rules": op8(),
            "op9_linked_secrets": op9(), "op10_warc_zstd": OP10, "op11_lyndon_runs": OP11,
            "op13_hat_trie_collocations": OP13}
